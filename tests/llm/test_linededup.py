"""Line dedup on tables with repeated rows."""

from callscape.llm import linededup

LINE = "This line is long enough to count as a repeated one."


def test_repeated_rows_count_once(spark):
    other = LINE.replace("This", "That")
    rows = [(i % 4, f"{LINE}\nrow {i % 4}") for i in range(12)] + [(i, f"{other.upper()}\nrow {i}") for i in range(10, 15)] + [(10, f"{other}\nmore")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((i, text if i < 10 or i == 14 else text.split("\n")[1]) for i, text in rows)
    assert sorted(map(tuple, linededup.apply(docs).collect())) == want

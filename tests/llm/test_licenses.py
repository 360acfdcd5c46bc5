"""Known licences as published: wrapped, under a title and a copyright line."""

import pathlib
import re
import textwrap

from callscape.llm import licenses

TITLE = {"MIT": "The MIT License (MIT)", "ISC": "ISC License", "0BSD": "BSD Zero Clause License", "Zlib": "zlib License", "BSD-2-Clause": "BSD 2-Clause License"}
HEADS = ["", "Copyright (c) 2019-2024, A. Writer <a@b.org>", "Copyright © 2020 The Authors\nAll rights reserved.", "Copyright The Authors and Contributors", "(c) 2011 Some Body"]


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.license for r in licenses.scan(docs).collect()}


def test_known_texts_as_published(spark):
    texts, want = [], []
    for name, body in licenses.KNOWN.items():
        for width in (*range(40, 90, 3), 10_000):
            for nth, head in enumerate(HEADS):
                wrapped = "\n\n".join(textwrap.fill(p, width) for p in body.split("\n"))
                text = "\n\n".join(x for x in (TITLE.get(name, "") if nth % 2 else "", head, wrapped) if x)
                texts.append(text.replace("\n", "\r\n") if width % 2 else text)
                want.append(name)
    assert found(spark, texts) == dict(enumerate(want))


def test_other_texts_are_not_licences(spark):
    mit = licenses.KNOWN["MIT"]
    texts = [None, "", "MIT License", mit + "\nExcept on Sundays.", mit.replace("without restriction", "with restrictions"), "ISC License\n" + mit[:200]]
    assert set(found(spark, texts).values()) == {None}


def test_longer_licences(spark):
    named = licenses.KNOWN["BSD-2-Clause"].replace("\nTHIS SOFTWARE", "\n3. Neither the name of Example Org. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE")
    texts = {"BSD-3-Clause": "BSD 3-Clause License\n\nCopyright (c) 2020, Example Org.\nAll rights reserved.\n\n" + textwrap.fill(re.sub(r"\n[0-9]\. ", "\n* ", named), 72)}
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0")):
        path = pathlib.Path("/usr/share/common-licenses") / file  # of Debian's base-files
        if path.exists():
            texts[name] = path.read_text()
    assert found(spark, list(texts.values())) == dict(enumerate(texts))

"""Licence files and notices as they are found."""

from sceneweave.llm import licences


def test_files_with_titles_names_and_wrapped_lines(spark):
    import textwrap

    wrap = lambda text, n: "\n".join("\n".join(textwrap.wrap(x, n)) for x in text.split("\n"))
    rows, want = [], {}
    for name, text in licences.TEXTS.items():
        for title in ["", *(t + "\n\n" for t in licences.TITLES[name])]:
            for owner in ("Copyright (c) 2020 Jane Doe", "Copyright Jane Doe", "Copyright Andrew Orson <a@b.c>"):
                for width in (40, 72):
                    want[len(rows)] = (name, 0, "")
                    rows.append((len(rows), f"{title}{owner}\n\n{wrap(text, width)}\n"))
    for notice, name in (("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("SPDX-License-Identifier: CC-BY-SA-4.0", "CC-BY-SA-4.0")):
        want[len(rows)] = (None, 1, name)
        rows.append((len(rows), f"text\n{notice}\nmore"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.n_notices, r.notice_ids) for r in licences.scan(docs, licences.known_licences(spark)).collect()}
    assert got == want


def test_long_texts_in_other_guise(spark):
    """Rewrapped, in capitals, with British spellings and a copyright line: the same licence."""
    import re
    import textwrap

    texts = dict(licences.long_texts()[::-1])
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(texts)
    rows, want = [], {}
    for name, text in texts.items():
        plain = "\n\n".join("\n".join(textwrap.wrap(p, 60)) if "opyright" not in p and "(c)" not in p.lower() else p for p in re.split(r"\n\s*\n", text))
        for guise in (plain, plain.upper(), f"Copyright 2021 A. Writer\n{plain.replace('license ', 'licence ')}", plain.replace("http:", "https:") + "\n\n"):
            want[len(rows)] = name
            rows.append((len(rows), guise))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licences.scan(docs, licences.known_licences(spark)).collect()}
    assert got == want


def test_equivalent_words_in_a_row_are_each_replaced(spark):
    docs = spark.createDataFrame([(0, "owner owner licence licence\nowner"), (1, "holder holder license license\nHolder"), (2, "holder holder license\nholder")], "doc_id long, text string")
    found = {r.doc_id: r.text_digest for r in licences.scan(docs, licences.known_licences(spark)).collect()}
    assert found[0] == found[1] != found[2]


def test_many_known_texts_are_joined_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(0, licences.MIT), (1, "text\nSPDX-License-Identifier: MIT")], "doc_id long, text string")
    usual = licences.scan(docs, licences.known_licences(spark)).collect()
    monkeypatch.setattr(licences, "MOST_BROADCAST", 0)
    assert sorted(licences.scan(docs, licences.known_licences(spark)).collect()) == sorted(usual)

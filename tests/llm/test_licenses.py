import re

import pytest

from pagequarry.llm import licenses, queries

MATCH = licenses._matcher(tuple(licenses.BASE.items()), tuple(licenses.NOTICES.items()))


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), sorted({x for _, x in at})


def test_postfix():
    assert licenses.to_postfix("mit or apache-2.0 and bsd".split()) == ["mit", "apache-2.0", "bsd", "and", "or"]
    assert licenses.to_postfix("( mit or gpl-2.0 with classpath ) and isc".split()) == ["mit", "gpl-2.0", "classpath", "with", "or", "isc", "and"]
    for bad in ("mit or", "or mit", "( mit", "mit )", "mit isc", "", "( )"):
        assert licenses.to_postfix(bad.split()) is None


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("SPDX-License-Identifier: MIT OR GPL-3.0-only", {"mit", "gpl-3.0-only"}, 0.9),
        ("SPDX-License-Identifier: MIT AND GPL-3.0-only\nmore", {"mit", "gpl-3.0-only"}, 0.5),
        ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception", {"gpl-2.0"}, 0.75),
        ("SPDX-License-Identifier: MIT OR", {"mit"}, 0.0),
        ("Released under the MIT License.", {"mit"}, 0.9),
        ("under the MIT License or the GNU General Public License, version 3", {"mit", "gpl-3"}, 0.9),
        ("under the MIT License. Other words stand between here. GNU General Public License, version 3", {"mit", "gpl-3"}, 0.5),
        ("licensed under the Apache License, Version 2.0", {"apache-2"}, 0.9),
        ("CC BY-NC 4.0", {"cc-by-nc"}, 0.3),
        ("plain words", set(), 0.0),
    ],
)
def test_expressions(text, labels, score):
    found = licenses.scan_text(text, MATCH)
    assert (set(found["labels"]), found["score"]) == (labels, pytest.approx(score))


def test_odd_rows(odd):
    rows = licenses.scan(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.n_words, r.n_base) for r in rows if r.doc_id in (0, 1, 2)} == {(0, 0)}
    assert licenses.scan(odd.limit(0)).count() == 0


def test_query_matches_brute_force(spark, sf_dir, documents):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op7_licenses(spark, sf_dir).collect():
        n, places, first, last, labels = brute(docs[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, places, first, last, ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    texts = ["cc by nc by nc cc BY-NC under the mit license under the MIT license version 2", "apache license version 2 apache license version 2", "ccé by nc"]
    for r, t in zip(sorted(licenses.scan(documents(texts)).collect(), key=lambda r: r.doc_id), texts, strict=True):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("SPDX-License-Identifier: MIT Copyright 2020 Foo", {"mit"}, 0.9),
        ("see SPDX-License-Identifier: (MIT OR GPL-3.0-only) and then more words follow", {"mit", "gpl-3.0-only"}, 0.9),
        ("SPDX-License-Identifier: MIT and then read on", {"mit"}, 0.9),
        ("the SPDX-License-Identifier: the tag we use", set(), 0.0),
        ("SPDX-License-Identifier: GPL-3.0+ or whatever you like", {"gpl-3.0+"}, 0.5),
        ("SPDX-License-Identifier: (MIT or python code", set(), 0.0),
        ("SPDX-License-Identifier: BSD-3-Clause AND (Apache-2.0 OR CC-BY-SA-4.0) text", {"bsd-3-clause", "apache-2.0", "cc-by-sa-4.0"}, 0.9),
        ("SPDX-License-Identifier: MIT or none of these", {"mit"}, 0.9),
        ("SPDX-License-Identifier: Ruby", {"ruby"}, 0.5),
        ("SPDX-License-Identifier: GPL-2.0-only WITH pleasure", {"gpl-2.0-only"}, 0.5),
        ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception This file is free", {"gpl-2.0"}, 0.75),
        ("SPDX-License-Identifier: MIT. Copyright", {"mit"}, 0.9),
        ("/* SPDX-License-Identifier: MIT */ SPDX-License-Identifier: GPL-3.0-only text", {"mit", "gpl-3.0-only"}, 0.5),
    ],
)
def test_words_after_a_tag_are_not_its_expression(text, labels, score):
    found = licenses.scan_text(text, MATCH)
    assert (set(found["labels"]), found["score"]) == (labels, pytest.approx(score))


def test_tags_are_read_where_they_stand():
    matcher = licenses._matcher(tuple(licenses.BASE.items()), tuple(licenses.NOTICES.items()))
    for text, labels in {
        "NOSPDX-License-Identifier: GPL-3.0\nSPDX-License-Identifier: MIT": ["mit"],
        "An SPDX license identifier is a tag.\nÄ SPDX-License-Identifier: Apache-2.0": ["apache-2.0"],
        "SPDX-License-Identifier: LicenseRef-" + "x" * 100: ["licenseref-" + "x" * 100],
    }.items():
        assert licenses.scan_text(text, matcher)["labels"] == labels

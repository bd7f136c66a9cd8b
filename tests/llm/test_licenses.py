from __future__ import annotations

import random

import pytest

from entitylake.llm import licenses
from entitylake.llm.queries import QUERIES


def longest_increasing(values):
    best = [1] * len(values)
    for i, v in enumerate(values):
        best[i] += max((best[j] for j in range(i) if values[j] < v), default=0)
    return max(best, default=0)


@pytest.mark.parametrize("seed", range(20))
def test_increasing_run(seed):
    rng = random.Random(seed)
    values = rng.sample(range(50), rng.randint(0, 30))
    run = [values[k] for k in licenses.increasing(values)]
    assert run == sorted(run) and len(run) == longest_increasing(values)


@pytest.mark.parametrize("seed", range(20))
def test_alignment_is_in_order_and_equal(seed):
    rng = random.Random(seed)
    a = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 20))]
    b = [x for x in a if rng.random() < 0.8] + [rng.choice("klm")]
    pairs = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_unique_words_survive_changes():
    template = licenses.words(licenses.TEMPLATES["mit"])
    text = list(template)
    text[10:12] = ["changed"]
    text.insert(30, "extra")
    assert len(licenses.patience(template, text)) >= len(template) - 4


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
@pytest.mark.parametrize("lead", [0, 1, 17, 500])
def test_each_template_is_found_wherever_it_stands(name, lead):
    template = licenses.words(licenses.TEMPLATES[name])
    text = ["filler"] * lead + template + ["more"] * 9 + template + template
    found = licenses.occurrences(template, text, 0.8)
    first = lead
    second = lead + len(template) + 9
    assert [(a, b) for a, b, _ in found] == [(first, first + len(template)), (second, second + len(template)), (second + len(template), second + 2 * len(template))]


def test_query_finds_the_notices(spark, sf):
    lines = {
        "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
        "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
        "mit-notice": "Released under the MIT License.",
        "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
        "all-rights-reserved": "All rights reserved.",
    }
    expected = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for name, line in lines.items():
            if n := r["text"].count(line):
                expected[r["doc_id"], name] = n
    found = {}
    for r in QUERIES["op8_license_scan"](spark, sf).where("coverage = 1").collect():
        found[r["doc_id"], r["license"]] = found.get((r["doc_id"], r["license"]), 0) + 1
    assert found == expected and expected


def test_odd_rows(spark, odd_docs, no_docs):
    templates = {"fox": "The quick brown fox jumps over the lazy dog", "none": "!!", "word": "word"}
    rows = licenses.license_scan(odd_docs, templates).collect()
    assert sorted((r["doc_id"], r["license"]) for r in rows if r["license"] == "fox") == [(1, "fox"), (1, "fox"), (2, "fox")]
    assert sum(r["license"] == "word" for r in rows) == 30_000
    kept = licenses.with_licenses(odd_docs.withColumn("licenses", odd_docs["score"]))
    assert kept.count() == odd_docs.count()
    assert licenses.license_scan(no_docs).count() == 0


NAMED = {
    "Released under the BSD License": {"bsd-notice"},
    "Released under the ISC License": {"isc-notice"},
    "Licensed under CC BY-SA 4.0": {"cc-by-sa-4.0-notice"},
    "Licensed under CC BY 4.0": {"cc-by-4.0-notice"},
    "Licensed under CC BY-NC-SA 4.0": {"cc-by-nc-sa-4.0-notice"},
    "This work is licensed under the GNU General Public License, version 2": {"gpl-2.0-notice"},
    "Licensed under the GNU General Public License, version 3": {"gpl-3.0-notice"},
    "Licensed under the GNU Lesser General Public License, version 2.1": {"lgpl-2.1-notice"},
    "All rights are hereby reserved": {"all-rights-reserved"},
    "Released under some License": set(),
    "Licensed under the Apache License, Version 1.1": set(),
}


def names(text):
    known = {name: licenses.words(t) for name, t in licenses.TEMPLATES.items()}
    return [r["license"] for r in licenses.found_in(licenses.words(text), known, licenses.RULES, 0.8)]


@pytest.mark.parametrize("sentence", sorted(NAMED))
@pytest.mark.parametrize("lead", [0, 1, 2, 7])
def test_relatives_are_told_apart_wherever_they_stand(sentence, lead):
    text = "filler " * lead + sentence + ". More text follows."
    assert set(names(text)) == NAMED[sentence] and len(names(text)) == len(NAMED[sentence])


def test_each_template_has_its_own_name_only():
    parts = {"apache-2.0-header": {"apache-2.0-notice"}}
    for name, text in licenses.TEMPLATES.items():
        assert set(names(text)) - parts.get(name, set()) == {name}
        assert licenses.RULES.get(name, licenses.Rule()).needed <= set(licenses.words(text))


def best_of_all_windows(template, text, coverage):
    """The highest coverage of any window up to twice the template's length."""
    shares = [0.0]
    for a in range(len(text)):
        for b in range(a + 1, min(a + 2 * len(template), len(text)) + 1):
            shares.append(len(licenses.patience(template, text[a:b])) / len(template))
    return max(s for s in shares) if max(shares) >= coverage - 1e-9 else 0.0


@pytest.mark.parametrize("seed", range(8))
def test_changed_stretches_equal_a_search_of_all_windows(seed):
    rng = random.Random(seed)
    template = [f"t{k}" for k in range(rng.randint(3, 10))]
    changed = [w for w in template if rng.random() > 0.12]
    for _ in range(rng.randint(0, len(template) // 2)):
        changed.insert(rng.randint(1, len(changed) or 1), rng.choice(["x", "y", template[0]]))
    expected = best_of_all_windows(template, ["f"] * 3 + changed + ["f"] * 3, 0.8)
    for lead in range(2 * len(template) + 2):
        found = licenses.occurrences(template, ["f"] * lead + changed + ["f"] * 9, 0.8)
        assert max((c for _, _, c in found), default=0.0) == pytest.approx(expected)
        assert [(a - lead, b - lead) for a, b, _ in found] == [
            (a - 40, b - 40) for a, b, _ in licenses.occurrences(template, ["f"] * 40 + changed + ["f"] * 9, 0.8)
        ]

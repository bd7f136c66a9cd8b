"""What keeps the Python workers of an executor few and small."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pytest

from entitylake.llm import common, decontaminate, lines, packing, quality

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def docs(spark):
    rows = [(i, f"line {i} of its own\nthe same line stands in each of them", "a") for i in range(2_500)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)


def sizes(batch):
    return batch.append_column("rows", pa.array([batch.num_rows] * batch.num_rows, pa.int64()))


def test_batches_are_cut_to_rows(spark):
    numbers = spark.range(0, 1_003, 1, 1)
    found = common.map_batches(numbers, sizes, "id long, rows long", rows=100).collect()
    assert [r["id"] for r in found] == list(range(1_003))
    assert {r["rows"] for r in found} == {100, 3}
    assert common.map_batches(spark.range(0), sizes, "id long, rows long", rows=100).count() == 0


@pytest.mark.parametrize(
    "module, run",
    [
        (packing, lambda docs: packing.pack(docs, PATH)),
        (quality, lambda docs: quality.scored(docs, quality.fit(quality.np.zeros((0, len(quality.FEATURES))), quality.np.zeros(0)))),
        (decontaminate, lambda docs: decontaminate.clean(docs, docs.limit(2).selectExpr("string(doc_id) item_id", "text"))),
    ],
)
def test_operators_hold_few_texts(docs, monkeypatch, module, run):
    asked = []

    def spied(df, fn, schema, **options):
        asked.append(options.get("rows"))
        return common.map_batches(df, fn, schema, **options)

    monkeypatch.setattr(module, "map_batches", spied)
    run(docs)
    assert asked and all(n and n <= common.TEXTS_AT_ONCE for n in asked)


def test_states_of_other_tasks_are_dropped(spark):
    def make(batch):
        common.worker_state("first", lambda: [0])
        return batch

    def held(batch):
        import sys

        name = getattr(sys.modules.get("_entitylake_worker"), "name", None)
        return pa.RecordBatch.from_pydict({"name": [name] * batch.num_rows})

    numbers = spark.range(0, 8, 1, 8)
    assert common.map_batches(numbers, make, "id long", state="first").count() == 8
    kept = common.map_batches(numbers, held, "name string", state="first").collect()
    assert {r["name"] for r in kept} <= {"first", None}
    assert {r["name"] for r in common.map_batches(numbers, held, "name string").collect()} == {None}


def chained(node, below=False):
    """Whether a stage of the plan has a row pass two Python workers."""
    name = node.nodeName()
    if name == "Exchange":
        below = False
    if name == "MapInArrow":
        if below:
            return True
        below = True
    children = node.children()
    return any(chained(children.apply(k), below) for k in range(children.size()))


def test_lines_are_cut_by_one_worker_a_task(docs):
    kept = lines.without_repeats(docs)
    assert not chained(kept._jdf.queryExecution().executedPlan().initialPlan())
    rows = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in kept.collect()}
    assert rows == {i: (t if i == 0 else t.split("\n")[0], 2, min(i, 1)) for i, t, _ in docs.collect()}

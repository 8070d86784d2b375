"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for each operator and stage."""

import corpus_pipeline
import pytest

from quarry.llm import decontam, langid, license, lines, lm, near, packing, pii, quality, sharding

from .helpers import CLASHING, EDGES, frame, rows

BENCH = [(1, "The cat sat on the mat and looked at the dog for a long while"), (2, None), (3, ""), (4, "too short"), (1, "The cat sat on the mat and looked at the dog for a long while")]


def bench(spark, of):
    return spark.createDataFrame(of, "item_id long, text string")


OPERATORS = {
    "identify": lambda s, d: langid.identify(d),
    "scan": lambda s, d: license.scan(d),
    "report": lambda s, d: pii.report(d, key=b"k"),
    "shard": lambda s, d: sharding.shard(d, shards=4),
    "pack": lambda s, d: packing.pack(d),
    "scores": lambda s, d: lm.scores(d),
    "near": lambda s, d: near.near_duplicates(d),
    "lines": lambda s, d: lines.drop_lines(d),
    "quality": lambda s, d: quality.quality(d),
    "matches": lambda s, d: decontam.matches(d, bench(s, BENCH)),
    "keep_one": lambda s, d: near.keep_one(d),
    "keep_good": lambda s, d: quality.keep_good(d),
    "without_leaks": lambda s, d: decontam.without_leaks(d, bench(s, BENCH)),
    "mask": lambda s, d: pii.mask(d, key=b"k"),
}
#: A row out for each row in.
EACH = ("identify", "report", "shard", "scores", "near", "lines", "quality", "mask")


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(spark, name):
    got = rows(OPERATORS[name](spark, frame(spark, EDGES)))
    if name in EACH:
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in EDGES)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert rows(OPERATORS[name](spark, frame(spark, EDGES).limit(0))) == []


def test_no_items(spark):
    d = frame(spark, EDGES)
    assert rows(decontam.matches(d, bench(spark, []))) == []
    assert decontam.without_leaks(d, bench(spark, [])).count() == len(EDGES)


def test_values(spark):
    d = frame(spark, EDGES)
    near_ = {(r["doc_id"], r["thash"]): r for r in rows(near.near_duplicates(d))}
    assert {r["class_id"] for r in near_.values() if r["doc_id"] in (5, 6)} == {5}
    assert {r["class_id"] for r in near_.values() if r["doc_id"] in (3, 4)} == {3, 4}
    kept = rows(near.keep_one(d))
    assert sum(r["doc_id"] == 9 for r in kept) == 1 and sum(r["doc_id"] in (5, 6) for r in kept) == 1
    assert sum(not (r["text"] or "").strip(" \t\n") for r in kept) == 4, "blank texts are classes of their own"
    langs = {r["doc_id"]: r for r in rows(langid.identify(d))}
    assert [langs[i]["lang_pred"] for i in (2, 3, 4, 8)] == ["und"] * 4 and langs[2]["score"] == 0
    assert all(r["n_tokens"] == 1 for r in rows(lm.scores(d)) if r["doc_id"] in (2, 3, 4))
    assert {r["doc_id"] for r in rows(decontam.matches(d, bench(spark, BENCH)))} == {1}
    pieces = rows(packing.pack(d))
    assert sum(r["length"] for r in pieces if r["doc_id"] in (2, 3)) == 2
    null_line = [r for r in rows(lines.drop_lines(d)) if r["doc_id"] in (2, 3)]
    assert [(r["n_lines"], r["n_dropped"], r["kept_text"]) for r in null_line] == [(1, 0, ""), (1, 0, "")]


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    for d in (frame(spark, EDGES), frame(spark, EDGES).limit(0)):
        out = stage(spark, d, "/root/testdata/sf0.001")
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == d.columns, name
        out.collect()


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES) - 1))
def test_other_columns_stay(spark, k):
    """Columns of whatever name hold what they held, wherever the row stays."""
    got = rows(corpus_pipeline.STAGES[k][1](spark, frame(spark, EDGES), "/root/testdata/sf0.001"))
    assert got and all({c: r[c] for c in CLASHING} == CLASHING for r in got)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)


def test_hot_join(spark, monkeypatch):
    from quarry.llm import common

    monkeypatch.setattr(common, "HOT", 5)
    d = spark.range(1000).selectExpr("CASE WHEN id < 400 THEN 1 WHEN id < 700 THEN id % 50 WHEN id < 900 THEN id END AS k", "id")
    one = d.filter("k is not null and k < 800").groupBy("k").count().selectExpr("k", "count AS n", "k * 2 AS twice")
    got = rows(common.hot_join(d, one, "k", "n", 1000))
    assert len(got) == 1000 and all(r["twice"] == (None if r["k"] is None or r["k"] >= 800 else 2 * r["k"]) for r in got)


def test_release_deletes_what_was_written(spark):
    from quarry.llm import common

    out = rows(near.near_duplicates(frame(spark, EDGES)))
    made = list(common._made)
    assert made and len(out) == len(EDGES)
    common.release(spark)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    assert not common._made
    for p in made:
        at = fs.Path(p)
        assert not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def test_without_a_shared_folder(spark, monkeypatch):
    from quarry.llm import common

    class Without:
        """The session, with spark.checkpoint.dir unset."""

        conf = type("C", (), {"get": staticmethod(lambda *_: None)})

        def __init__(self, master):
            self.sparkContext = type("S", (), {"master": master, "getConf": staticmethod(dict)})

    assert common.shared_dir(Without("local[2]")) == common.shared_dir(Without("local[4]")) != common.shared_dir(spark)
    with pytest.raises(RuntimeError):
        common.shared_dir(Without("spark://host:7077"))

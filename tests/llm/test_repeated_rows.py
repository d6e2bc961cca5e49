"""Many rows equal in doc_id and text: the results of plain rows, from one row each."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import common, fingerprints, lm, packing

SCHEMA = "doc_id long, text string, n long"
WORDS = [f"w{i}" for i in range(90)]
RNG = np.random.default_rng(11)
OTHERS = [(i, " ".join(RNG.choice(WORDS, int(n))), 1) for i, n in enumerate(RNG.integers(5, 60, 60))]
HOT = [(None, "a text without an id, again and again", 2500), (7, None, 2200), (None, "", 1500), (30, "x" * 400, 1200), (61, "few of these", 5)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = common.repeated(spark.createDataFrame(OTHERS + HOT, SCHEMA), "n", "place")
    return rows.select("doc_id", "text").repartition(5).persist()


def plain(monkeypatch):
    monkeypatch.setattr(common, "MANY_BYTES", 1 << 60)


def counted(df):
    return Counter(map(tuple, df.collect()))


def test_equal_rows_are_found_and_counted(docs):
    once, equal = common.split_repeats(docs, "n")
    assert {(r.doc_id, r.text): r.n for r in equal.collect()} == {(i, t): n for i, t, n in HOT[:4]}
    assert counted(once) == Counter([*OTHERS, *[(61, "few of these", 1)] * 5])


def test_kinds_beyond_the_broadcast(docs, monkeypatch):
    monkeypatch.setattr(common, "MOST_KINDS", 0)
    once, equal = common.split_repeats(docs, "n")
    assert equal.count() == 4 and once.count() == len(OTHERS) + 5


def test_none_are_many(spark):
    once, equal = common.split_repeats(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string"), "n")
    assert equal is None and sorted(map(tuple, once.collect()), key=repr) == [(1, "a", 1), (1, "a", 1), (None, None, 1)]


@pytest.mark.parametrize("operator", [fingerprints.fingerprint_documents, lambda d: lm.score_corpus(d, F.col("doc_id") % 7 == 2)], ids=["op1", "op5"])
def test_results_are_those_of_plain_rows(docs, monkeypatch, operator):
    got = counted(operator(docs))
    plain(monkeypatch)
    assert got == counted(operator(docs)) and sum(got.values()) == docs.count()


def test_equal_rows_are_packed_in_several_groups(docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 50_000)
    monkeypatch.setattr(packing, "MANY_BYTES", 1 << 17)
    packed = packing.pack_documents(docs, row=256)
    pieces = packed.select((F.col("pack_id").bitwiseAND(~0xFFFFFFFF)).alias("group"), F.explode(F.arrays_zip("doc_ids", "offsets", "lengths")).alias("p")).persist()
    whole = Counter((i, bool(o)) for i, o in pieces.select("p.doc_ids", "p.offsets").collect())
    want = Counter({(i, False): n for i, n in docs.groupBy("doc_id").count().collect()})
    assert {k: n for k, n in whole.items() if not k[1]} == dict(want)
    assert pieces.where("p.doc_ids IS NULL").select("group").distinct().count() > 5
    again = packing.pack_documents(docs.repartition(2), row=256)
    assert counted(packed.select("pack_id", "ids", F.transform("doc_ids", lambda x: x.cast("string")).cast("string"))) == counted(again.select("pack_id", "ids", F.transform("doc_ids", lambda x: x.cast("string")).cast("string")))

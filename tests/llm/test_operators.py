"""The operators against brute force, round trips and edge cases: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoloom.llm import decontamination, exchange, fingerprints, lm, mixing, neardup, packing, queries, secrets, sharding, toxicity, warc
from chronoloom.llm.common import NOT_ALNUM, Words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, weight string, score string"
RNG = np.random.default_rng(5)
VOCAB = ["".join(RNG.choice(list("abcdefgh"), 5)) for _ in range(400)]
prose = lambda n: " ".join(RNG.choice(VOCAB, n))
BASE = prose(200)
NEAR = BASE.replace(BASE.split()[50], "changed", 1)
PHRASE = prose(14)
TEXTS = [BASE, BASE, NEAR, prose(120), "", "", None, None, "É", " \t\n", f"{prose(30)} {PHRASE.upper()}, {prose(30)}", f"key: password = 'hunter22xyz' AKIA{'Q' * 16} {'0a' * 15}", prose(30000)]
ROWS = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0, "x", "y", "z") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s0", 0, "x", "y", "z"), (None, BASE, "en", "s1", 0, "x", "y", "z"), (None, "lonely words without any id", "en", "s1", 0, "x", "y", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_are_the_regular_expression_s():
    texts = ["Ab  cÉ\x0bd", None, "", " x ", "a-b_1Ü"]
    for sep, p in (((), r"[^\x20\x09-\x0D]+"), ((NOT_ALNUM,), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = Words(texts, *sep)
        lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
        want = [m for t in lower for m in re.findall(p, t)]
        got = [w.buffer[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
        assert got == want and w.count.tolist() == [len(re.findall(p, t)) for t in lower]


def test_closed_syncmers_by_brute_force():
    text = prose(60)
    at, hashes = fingerprints.closed_syncmers(text)
    order = {text[i : i + 4]: int(fingerprints.mix(fingerprints._polynomial(fingerprints._codes(text[i : i + 4]), 4))[0]) for i in range(len(text) - 3)}
    want = [i for i in range(len(text) - 10) if min(order[text[j : j + 4]] for j in range(i, i + 8)) in (order[text[i : i + 4]], order[text[i + 7 : i + 11]])]
    assert at.tolist() == want
    assert len({text[i : i + 11] for i in at}) == len(set(hashes.tolist()))
    moved = fingerprints.closed_syncmers("zz" + text)[1]
    assert set(hashes.tolist()) <= set(moved.tolist())  # free of context


def test_fingerprints(docs, none):
    out = fingerprints.fingerprint_documents(docs).toPandas()
    assert len(out) == len(ROWS)
    order = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    texts = [r["text"] or "" for r in sorted(order, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"] is not None))]
    want = Counter(hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest() for t, n in zip(texts, texts[1:] + texts[:1]))
    assert Counter(out["edited_sha256"]) == want
    one = out.set_index("doc_id")
    assert one.loc[0, "fingerprint"] == one.loc[1, "fingerprint"] and one.loc[0, "near_next"] == 1 and one.loc[1, "near_next"] > 0.8
    assert out[out.n_chars > 200].near_edited.between(0.3, 0.9).all()
    assert fingerprints.fingerprint_documents(none).count() == 0


def test_fingerprints_of_hot_ids(spark):
    """A third of the rows without an id and a third of one id: their ranges follow each other as one order of all rows."""
    rows = [(None if i % 3 == 0 else 50 if i % 3 == 1 else i, prose(4) if i % 10 else "same") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = fingerprints.fingerprint_documents(df)
    order = sorted(df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    texts = [r["text"] for r in order]
    want = Counter((r["doc_id"], hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest()) for r, t, n in zip(order, texts, texts[1:] + texts[:1]))
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in out.collect()) == want
    spread = out.withColumn("p", F.spark_partition_id()).where("doc_id IS NULL").groupBy("p").count().collect()
    assert len(spread) > 3 and max(r["count"] for r in spread) < 60


def test_likeness_estimates_the_share_of_anchors():
    """Against the true Jaccard similarity of the sets of anchors, at several shares of common text."""
    for share in (0.0, 0.3, 0.6, 0.9):
        a = prose(600)
        b = a[: int(len(a) * share)] + " " + prose(int(600 * (1 - share)))
        x, y = (set(fingerprints.closed_syncmers(t)[1].tolist()) for t in (a, b))
        got = fingerprints.likeness(fingerprints.fingerprint(a)[0], fingerprints.fingerprint(b)[0])
        assert got == pytest.approx(len(x & y) / len(x | y), abs=0.15)


def test_passages_by_position():
    """Shared passages are found where they stand, whole and to the character; what is found is shared and can't be extended."""
    shared = prose(30)
    a, b = f"{prose(20)} {shared} {prose(10)}", f"{prose(7)}\u00e9 {shared}! {prose(25)} {shared}"
    found = fingerprints.matches(a, b)
    for start in (b.index(shared), b.rindex(shared)):
        assert any(x <= a.index(shared) and y <= start and x - y == a.index(shared) - start and n >= len(shared) for x, y, n in found)
    for x, y, n in found:
        assert a[x : x + n] == b[y : y + n] and n >= fingerprints.K
        assert (min(x, y) == 0 or a[x - 1] != b[y - 1]) and (x + n == len(a) or y + n == len(b) or a[x + n] != b[y + n])
    assert fingerprints.matches(a, prose(5)) == [] == fingerprints.matches("", b) and fingerprints.matches(a, a)[0] == (0, 0, len(a))


def test_packing_round_trip(docs, none):
    out = packing.pack_documents(docs, row=256).collect()
    pieces: dict = {}
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == 256 and r["cu_seqlens"][-1] == r["n_tokens"] and list(np.diff(r["cu_seqlens"])) == r["lengths"]
        assert packing.positions(r["cu_seqlens"])[r["resets"]].tolist() == [0] * len(r["resets"])
        for d, o, a, n in zip(r["doc_ids"], r["offsets"], r["cu_seqlens"], r["lengths"]):
            pieces.setdefault(d, {}).setdefault(o, []).append(ids[a : a + n])
    for i in (0, 2, 10, 12):
        assert packing.decode(np.concatenate([pieces[i][o][0] for o in sorted(pieces[i])])) == TEXTS[i]
    assert len(pieces[3][0]) == 2 and pieces[4][0][0].tolist() == [packing.END_ID] == pieces[6][0][0].tolist()
    assert packing.pack_documents(none).count() == 0


def test_best_fit_decreasing_by_brute_force():
    lengths = RNG.integers(1, 65, 300).tolist()
    left, want = [], []
    for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
        fits = [(c, r) for r, c in enumerate(left) if c >= lengths[i]]
        if fits:
            r = next(r for c, r in fits if c == min(fits)[0])
        else:
            r = len(left)
            left.append(64)
            want.append([])
        left[r] -= lengths[i]
        want[r].append(i)
    got = packing.best_fit_decreasing(lengths, 64)
    assert len(got) == len(want) and sorted(sum(lengths[i] for i in r) for r in got) == sorted(sum(lengths[i] for i in r) for r in want)


def test_archives(spark, none, tmp_path):
    pages = [(5, "http://a/\r\nx", "<p>é</p>", 1), (2, None, "<p>é</p>", 1), (9, "u", None, 1), (7, "u", "", 1), (8, "u", "x" * 100000, 1), (None, "u", "<p>é</p>", 1), (2, None, "<p>é</p>", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload int").repartition(2)
    warc.write_archives(df, f"file://{tmp_path}/a")
    out = [tuple(r) for r in warc.read_archives(spark, f"file://{tmp_path}/a").collect()]
    kinds = Counter((r[0], r[4], r[5]) for r in out)
    assert kinds == Counter({(2, "response", None): 2, (5, "revisit", 2): 1, (None, "revisit", 2): 1, (7, "response", None): 1, (9, "revisit", 7): 1, (8, "response", None): 1})
    assert {r[0]: (r[1], r[2], r[3]) for r in out}[5] == ("http://a/\r\nx", 9, warc.digest("<p>é</p>".encode()))
    assert {r[0]: r[6] for r in out}[8] == b"x" * 100000
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/b")
    assert warc.read_archives(spark, f"file://{tmp_path}/b").count() == 0


def test_broken_archives():
    records = [warc.page_record(i, "u", b"<p>%d</p>" % i * 30, None) for i in range(50)]
    whole = warc.write_archive(records)
    assert whole[:4] == (0x184D2A5D).to_bytes(4, "little") and len(list(warc.read_archive(whole))) == 50
    for broken in (whole[:-3], whole[:-40] + b"\0" + whole[-39:], whole + b"junkjunk"):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(broken))
    with pytest.raises(warc.ArchiveError):
        warc.parse_record(records[0].replace(b"Content-Length: 3", b"Content-Length: 4"))


def test_sharding(spark, docs, none):
    many = spark.createDataFrame([(i, f"t{i}" if i % 3 else "same" if i % 2 else f"pair{i % 90}") for i in range(700)] + [(None, "single"), (1007, "\u00e9"), (1008, None), (1009, "")], "doc_id long, text string")
    out, rows = sharding.assign_shards(many).toPandas(), many.collect()
    sizes = out.groupby("shard").size()
    assert len(out) == len(rows) and sizes.max() - sizes.min() <= 1 and len(sizes) == 24
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    # Sizes, checksums and groups by brute force; edges are the pairs of equal texts.
    groups = Counter(r["text"] for r in rows)
    one = lambda t: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), groups[t])
    plain = lambda rs: sorted((-1 if i is None or i != i else int(i), *r) for i, *r in rs)
    assert plain(out[["doc_id", "size", "text_crc32", "group_size"]].itertuples(index=False, name=None)) == plain((r["doc_id"], *one(r["text"])) for r in rows)
    whole = out[out.doc_id < 700].merge(pd.DataFrame(rows, columns=["doc_id", "text"]), on="doc_id")
    pairs, same = whole[whole.text.str.startswith("pair")], whole[whole.text == "same"]
    together = same.groupby("shard")["shard"].transform("size") - 1
    assert (same.mates_after == together).all() and same["shard"].nunique() < 24
    assert pairs.mates_after.sum() > 0.8 * (pairs.group_size - 1).sum() and pairs.mates_before.sum() < 0.2 * (pairs.group_size - 1).sum()
    assert (out[out.group_size == 1][["mates_before", "mates_after"]] == 0).all().all()
    small = sharding.assign_shards(docs).toPandas()
    assert len(small) == len(ROWS) and small.groupby("shard").size().max() == 1
    assert sharding.assign_shards(none).count() == 0


def slow_model(rows, held, masses):
    """Scores by the recurrence over dictionaries: for each row n_tokens, n_known, train_tokens, base_score, score."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    paths = [["<s>", *re.findall(r"[^\x20\x09-\x0D]+", lower(t)), "</s>"] for _, t in rows]
    grams = Counter()
    for p, h in zip(paths, held):
        for i in range(len(p) if not h else 0):
            for n in range(1, len(masses) + 2):
                if i - n + 1 >= 0:
                    grams[tuple(p[i - n + 1 : i + 1])] += 1
    known = {g[0]: c for g, c in grams.items() if len(g) == 1 and g != ("<s>",)}
    total, size = sum(known.values()), sum(known.values()) + len(known) + 1

    def chance(history, w):
        if not history:
            return (known.get(w, 0) + 1) / size
        m = masses[len(history) - 1]
        return (grams[(*history, w)] + m * chance(history[1:], w)) / (grams[history] + m)

    out = []
    for p in paths:
        score = sum(np.log10(chance(tuple(p[max(0, i - len(masses)) : i]), p[i])) for i in range(1, len(p)))
        out.append((len(p) - 1, sum(w in known for w in p[1:]), total, sum(np.log10((known.get(w, 0) + 1) / size) for w in p[1:]), score))
    return out


@pytest.mark.parametrize("masses", [lm.MASSES, (3.0,), (5.0, 2.0, 1.0), ()])
def test_automaton_by_brute_force(spark, masses):
    """Null, empty and repeated texts, ids that are missing or repeated, words that only held-out texts have; an order of 1 to 4."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "B", "c", "\u00c9", "d-e"], n)) for n in (1, 2, 3, 5, 40, 300)] + [None, "", " \t", "new words", "new words"]
    rows = [(i % 8 if i != 5 else None, t) for i, t in enumerate(texts)] + [(4, texts[4])] * 3
    held = [t is not None and "new" in t for _, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lm, "text_totals", lambda d: (len(rows), 40 << 20))  # several blocks
        got = lm.score_corpus(df, F.coalesce(F.col("text").contains("new"), F.lit(False)), masses).collect()
    plain = lambda rs: sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in rs)
    want = plain([(i, *r) for (i, _), r in zip(rows, slow_model(rows, held, masses))])
    for a, b in zip(plain([(r[0], *r[2:]) for r in got]), want, strict=True):
        assert a == pytest.approx(b, abs=1e-6)  # scores are rounded to 6 decimals


def test_automaton_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    got = {r["doc_id"]: r for r in queries.op5_backoff(spark, SF).collect()}
    for (i, _), h, want in zip(rows, held, slow_model(rows, held, lm.MASSES), strict=True):
        assert got[i]["held_out"] == h and tuple(got[i])[2:] == pytest.approx(want, rel=1e-6)


def test_no_training_text_gives_zero(spark, none):
    out = lm.score_corpus(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), F.lit(True)).collect()
    assert [(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in out] == [(0, 0, 0, 0)] * 2
    assert lm.score_corpus(none, F.lit(False)).count() == 0


def test_count_exchange_packets():
    keys = np.unique(RNG.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    sent = exchange.send(3, keys, np.arange(len(keys)), 7, 0)
    assert np.concatenate([np.cumsum(exchange.unpack(p[3]), dtype=np.uint64) for p in sent]).tolist() == keys.tolist()
    assert np.concatenate([exchange.unpack(p[4]) for p in sent]).tolist() == list(range(len(keys)))


def test_network_learns_a_word():
    texts = [prose(40) + (" wretch " if i % 2 else " ") + prose(100) for i in range(160)]
    n = toxicity.Network()
    n.fit(texts[:120], np.arange(120) % 2)
    s = n.scores([*texts[120:], "", None])
    assert ((s[:40] >= 0.5) == (np.arange(40) % 2 == 1)).mean() > 0.9 and s[40] == s[41] < 0.5
    untouched = toxicity.Network()
    untouched.fit(["a b"], np.array([1]))
    assert (untouched.scores(["a b"]) < 0.5).all()


def test_windows_hold_passages_at_every_offset():
    """Half a window of words lies whole in a window wherever it stands; of a passage of a window's length, more than half does."""
    half = toxicity.WINDOW // 2
    for n in (1, half, toxicity.WINDOW, toxicity.WINDOW + 1, 200, 333):
        seen = toxicity.Inputs([" ".join(f"w{i}" for i in range(n))])
        spans = []
        begin = 0
        for length in seen.length.tolist():
            spans.append((begin, begin + length))
            begin += toxicity.STRIDE
        assert spans[-1][1] == n
        for size, least in ((half + 1, half + 1), (toxicity.WINDOW, half + 1)):
            for at in range(max(n - size + 1, 0)):
                assert max(min(b, at + size) - max(a, at) for a, b in spans) >= least


def test_toxicity_edges(docs, none):
    net = toxicity.Network()
    out = toxicity.score_documents(docs, net, F.col("doc_id") == 2).toPandas()
    assert len(out) == len(ROWS) and out.score.between(0, 1).all() and out.held_out.sum() == 1
    assert toxicity.score_documents(none, net, F.lit(False)).count() == 0


def test_scores_by_brute_force():
    """Window by window and word by word: the gates, the attention and the worst window, from the network's numbers."""
    net = toxicity.Network(3)
    sig = lambda x: 1 / (1 + np.exp(-x))
    p, h = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    texts = [prose(n) for n in (1, 5, 64, 65, 97, 200)]

    def slow(text):
        words, best = text.split(), -np.inf
        inputs = {w: net.words(toxicity.Inputs([w]))[0].astype(float) for w in set(words)}
        for begin in range(0, max(len(words) - toxicity.WINDOW, 0) + toxicity.STRIDE, toxicity.STRIDE):
            window, states = words[begin : begin + toxicity.WINDOW], {}
            for s, run in (("f", list(enumerate(window))), ("b", list(enumerate(window))[::-1])):
                state = np.zeros(h)
                for t, w in run:
                    x, r = inputs[w] @ p[f"x{s}"] + p[f"b{s}"], state @ p[f"u{s}"]
                    z, c = sig(x[:h] + r[:h]), sig(x[h : 2 * h] + r[h : 2 * h])
                    n = np.tanh(x[2 * h :] + c * r[2 * h :])
                    state = n + z * (state - n)
                    states.setdefault(t, {})[s] = state
            both = np.array([np.r_[states[t]["f"], states[t]["b"]] for t in range(len(window))])
            e = np.exp(np.tanh(both @ p["wa"]) @ p["va"])
            best = max(best, float((e / e.sum()) @ both @ p["wo"] + p["bo"][0]))
        return sig(best)

    assert net.scores(texts) == pytest.approx([slow(t) for t in texts], abs=1e-5)


def test_training_on_tables(spark, docs, none, monkeypatch):
    """Labels that are null, repeated, in conflict or without a text; ids with several texts; held-out rows; the bounds of the sample."""
    seen = {}
    monkeypatch.setattr(toxicity.Network, "fit", lambda self, texts, labels, informed: seen.update(rows=sorted(zip(texts, labels.tolist()))))
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (1, 0), (2, None), (3, 0), (4, 1), (6, 1), (10, 0), (12, 0), (77, 1), (None, 1), (11, 1)], "doc_id long, toxic int")
    toxicity.train(docs, labels, F.col("doc_id") == 11)
    assert seen["rows"] == sorted([(BASE, 1), (BASE, 0), (TEXTS[3], 0), (TEXTS[3], 0), (TEXTS[10], 0), (TEXTS[12], 0)])
    toxicity.train(docs, labels, F.lit(False), sample=1)
    assert Counter(k for _, k in seen["rows"]) == {0: 1, 1: 1}
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 2000)
    toxicity.train(docs, labels, F.lit(False))
    assert sum(len(t) for t, k in seen["rows"] if not k) <= 2000
    toxicity.train(none, labels, F.lit(False))
    assert seen["rows"] == []
    monkeypatch.undo()
    assert (toxicity.train(none, labels.limit(0), F.lit(False)).scores(["a b", ""]) < 0.5).all()


def test_long_texts_are_learnt_from_their_highest_windows():
    x, net = toxicity.Inputs([prose(30), prose(64 * 60), prose(64 * 3)]), toxicity.Network(5)
    pick = net.highest(x, 8)
    scores = net.forward(x)
    own = pick[x.doc[pick] == 1]
    assert (x.doc[pick] == 0).sum() == 1 and (x.doc[pick] == 2).sum() == 5 and len(own) == 8
    assert scores[own].min() >= np.sort(scores[x.doc == 1])[-8]


def test_network_learns_without_informed_embeddings():
    """Held-out accuracy on labels of sf0.1 (3,155 training texts) is in the README; here a word of its own class is learnt from scratch."""
    texts = [prose(40) + (" wretch " if i % 2 else " ") + prose(100) for i in range(440)]
    n = toxicity.Network()
    n.fit(texts[:400], np.arange(400) % 2, informed=False)
    assert ((n.scores(texts[400:]) >= 0.5) == (np.arange(40) % 2 == 1)).mean() > 0.9


def test_secrets(spark, docs, none):
    out = secrets.report(secrets.scan_corpus(docs)).toPandas()
    assert len(out) == len(ROWS)
    hit = out[out.doc_id == 11].iloc[0]
    assert (hit.n_assign, hit.n_access, hit.n_hex, hit.n_live) == (1, 1, 1, 1)  # the other two lack variety
    t = TEXTS[11]
    assert hit.spans.split(",") == [f"assign:5:{t.index(chr(39), 20)}", f"access:{t.index('AKIA')}:{t.index('AKIA') + 20}", f"hex:{t.index('0a')}:{len(t)}"]
    assert out[out.doc_id == 4].base_sha256.iloc[0] == hashlib.sha256(b"").hexdigest()
    shared = spark.createDataFrame([(i, "token=qwertyuiop1", f"o{i}") for i in range(3)] + [(9, "éé token: token: abcdefgh secret=zxcvbnm99", "o1")], "doc_id long, text string, source string")
    rows = {r["doc_id"]: r for r in secrets.report(secrets.scan_corpus(shared)).collect()}
    assert rows[0]["n_copied"] == 1 and rows[0]["most_owners"] == 3 and rows[9]["n_live"] == 1 and rows[9]["n_assign"] == 1
    assert secrets.scan_corpus(none).count() == 0


def test_secrets_equal_their_sql(spark):
    """Positions in code points, either case of ASCII letters alone, touching and broken matches, every kind, repeated rows, null owners."""
    token, dotted = "ghp_" + "aB3" * 12, "eyJ" + "ab01" * 3 + "." + "cd23" * 3 + ".ef45"
    texts = [
        "\U0001F511\U0001F511 PASSWD:=x password=secret=abcdef1 pa\u017f\u017fword=hunter22 to\u212aen=hunter22",
        f"api_key: 'Zq9+/=.-x' APIKEY=short Secret\" :  \"{'é'}abcdefg TOKEN\n=abcdefg token=\x0babcdefg",
        f"xAKIAAKIA{'Z' * 16}AKIA{'1' * 15} AKIA{'2' * 15}a AKIA{'3' * 40} {'ab' * 12}{'AB' * 12}{'0f' * 11} {'9' * 24}",
        f"{token} {dotted} xoxb-1234567890-abc -----BEGIN RSA PRIVATE KEY----- url://me:pa55wörd!@host a://b\x0bc:d@e h2://u:p@x@y",
        f"token={token} secret: {'de' * 20} password=EXAMPLE12345 api-key=abcdefgh passwordpassword==aaaaaaaaaa",
        "", None, "password", "=" * 50, " ".join(f"secret=value{i % 7}{'x' * (i % 9)}" for i in range(500)), "token=abcdefg " * secrets.PART, "token=abcdefg\u00e9" * (3 * secrets.PART + 1),
    ]
    rows = [(i, t, f"o{i % 3}" if i % 4 else None) for i, t in enumerate(texts * 2)] + [(1, texts[1], "o1"), (None, texts[3], "o9")]
    got = secrets.report(secrets.scan_corpus(spark.createDataFrame(rows, "doc_id long, text string, source string"))).toPandas()
    duck = duckdb.connect()
    duck.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    want = duck.execute(secrets.ORACLE).df()
    names = sorted(want)
    assert names == sorted(got) and len(want) == len(rows)
    plain = lambda df: sorted(tuple(str(x).removesuffix(".0") for x in r) for r in df[names].fillna(-1).itertuples(index=False))
    assert plain(got) == plain(want)
    assert all(k in " ".join(got.spans) for k in secrets.KINDS)


def test_secrets_copied_within_one_owner(spark):
    """Repositories count besides owners: at the bound a secret of one owner is live-looking, beyond it a copy; repeated rows are one repository."""
    few, many = "token=qwertyuiop1", "token=zxcvbnmasd2"
    rows = [(i, few, "o1") for i in range(secrets.MAX_REPOS)] + [(0, few, "o1")] + [(100 + i, many, "o1") for i in range(secrets.MAX_REPOS + 1)] + [(500, f"{few} {many}", None)]
    docs = spark.createDataFrame(rows[:-1], "doc_id long, text string, source string")
    out = secrets.report(secrets.scan_corpus(docs)).collect()
    assert {(r["doc_id"] < 100, r["n_live"], r["n_copied"], r["most_owners"], r["most_repos"]) for r in out} == {(True, 1, 0, 1, secrets.MAX_REPOS), (False, 0, 1, 1, secrets.MAX_REPOS + 1)}
    assert len(out) == len(rows) - 1
    both = secrets.scan_corpus(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {(r["n_live"], r["most_owners"]) for r in both.collect()} == {(0, 2)}


def test_mixing(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (3, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    sized = mixing.sized(docs, labels, F.col("score").alias("target"))
    out = mixing.mix_documents(sized).toPandas()
    assert len(out) == len(ROWS) and (out.taken <= 2 * out["size"]).all()
    for _, g in out.groupby(out.source.fillna("~")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2 and g.target.iloc[0] <= 2 * g["size"].sum() + 1e-9
    assert out.groupby(out.source.fillna("~")).target.first().sum() == pytest.approx(1.5 * out["size"].sum())
    assert sorted(out.taken) == sorted(mixing.mix_documents(sized.repartition(5)).toPandas().taken)
    assert mixing.mix_documents(mixing.sized(none, labels)).count() == 0


def test_mixing_equals_its_sql(spark, docs):
    """Ids that are missing or repeated, a source that is missing, sources that stop at twice their size, an empty source."""
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()] + [(50 + i, "a b c " * (i % 5), "big" if i else "nought") for i in range(40)]
    labels = [(0, 1), (0, 0), (3, 0), (None, 1), (51, 1), (52, None)]
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = mixing.mix_documents(mixing.sized(frame, marks)).select("doc_id", "size", F.col("source_size").cast("long"), "target", "taken").toPandas()
    duck = duckdb.connect()
    duck.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    duck.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality"]).astype("Int64"))
    want = duck.execute(mixing.ORACLE).df()
    plain = lambda df: sorted(tuple(r) for r in df[sorted(want)].astype(float).fillna(-1).itertuples(index=False))
    assert sorted(got) == sorted(want) and plain(got) == plain(want)


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([("b1", PHRASE), ("b2", None), ("b3", "É"), ("b4", prose(20)), (None, PHRASE), ("b1", "other words here")], "item_id string, text string")
    index = decontamination.Index(docs.select("doc_id", "text"), items)
    out = {r["doc_id"]: r for r in decontamination.report(decontamination.phrase_matches(docs, index)).collect()}
    assert (out[10]["n_hit"], out[10]["n_items"], out[10]["n_words"]) == (14, 1, 74) and out[10]["items_sha256"] == hashlib.sha256(b"b1").hexdigest()
    assert out[8]["n_hit"] == 1 and sum(r["contaminated"] for r in out.values()) == 2
    assert decontamination.phrase_matches(docs, index).count() == len(ROWS)
    assert (10, "b1") in [(r["doc_id"], r["item_id"]) for r in decontamination.proximity_matches(index).collect()]
    empty = decontamination.Index(docs.select("doc_id", "text"), items.limit(0))
    assert decontamination.phrase_matches(docs, empty).where(F.size("hits") > 0).count() == 0
    assert decontamination.phrase_matches(none, decontamination.Index(none.select("doc_id", "text"), items)).count() == 0


def test_sampling_estimates_weighted_jaccard():
    keys = np.sort(RNG.integers(0, 1 << 62, 300).astype(np.uint64))
    wa, wb = RNG.integers(1, 50, 200), RNG.integers(1, 50, 250)
    wb[:150] = wa[50:]
    a, b = (keys[:200], wa), (keys[50:], wb)
    drawn = neardup.samples(np.r_[a[0], b[0]], np.log(np.r_[a[1], b[1]]).astype(np.float32), np.array([0, 200]), 3000)
    assert (drawn[0] == drawn[1]).mean() == pytest.approx(neardup.weighted_jaccard(a, b), abs=0.04)


def slow_classes(rows, threshold=neardup.THRESHOLD):
    """Class ids by comparing all texts with all: integer weights from dictionaries, links of at least the threshold, connected texts."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    df = Counter(w for _, t in rows for w in set(words(t)))
    idf = {w: int(np.rint(neardup.IDF_STEPS * np.log1p(len(rows) / c))) for w, c in df.items()}
    vectors = {}
    for _, t in rows:
        ws = words(t)
        v = vectors.setdefault(t, Counter()) if ws and t not in vectors else Counter()
        for i in range(max(len(ws) - neardup.SHINGLE + 1, 1)):
            v[tuple(ws[i : i + neardup.SHINGLE])] += sum(idf[w] for w in ws[i : i + neardup.SHINGLE])
    texts, root = sorted(vectors), {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    total = {t: sum(v.values()) for t, v in vectors.items()}
    linked = 0
    for k, a in enumerate(texts):
        for b in texts[:k]:
            less = sum((vectors[a] & vectors[b]).values())
            if less >= threshold * (total[a] + total[b] - less):
                linked += 1
                root[find(a)] = find(b)
    name = lambda i, t: (None, i) if t is None else find(t)
    ids = {}
    for i, t in rows:
        if i is not None:
            ids[name(i, t)] = min(i, ids.get(name(i, t), i))
    return [(i, ids.get(name(i, t))) for i, t in rows], linked


def class_rows(df):
    return sorted((str(r["doc_id"]), str(r["class_id"])) for r in df.collect())


def test_classes_of_documents_by_brute_force(spark):
    """All pairs of the smallest table: the bands lose no class of texts at the threshold."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want, _ = slow_classes([tuple(r) for r in docs.collect()])
    assert class_rows(neardup.near_classes(docs)) == sorted((str(a), str(b)) for a, b in want)


def test_classes_by_brute_force(spark):
    """Near copies of 1 to 8 edits on both sides of the threshold, ids that are missing or repeated, short, empty and missing texts."""
    rng, rows = np.random.default_rng(8), []
    for k in range(60):
        base = rng.choice(VOCAB, 130)
        rows.append((3 * k, " ".join(base)))
        copy = base.copy()
        copy[rng.integers(0, 130, k % 8 + 1)] = [f"edit{k}x{j}" for j in range(k % 8 + 1)]
        rows.append((3 * k + 1 if k % 7 else None, " ".join(copy)))
    rows += [(500, rows[0][1]), (500, "other text of the same id"), (None, rows[4][1]), (None, "nowhere else"), (501, "two words"), (None, "Two  words"), (502, "two words"), (503, ""), (504, ""), (505, None), (505, None), (506, None), (507, "--"), (None, None), (None, None)]
    want, linked = slow_classes(rows)
    assert 15 < linked < 45
    got = class_rows(neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert got == sorted((str(a), str(b)) for a, b in want)


def test_near_duplicates(docs, none, spark):
    out = neardup.near_classes(docs).toPandas()
    assert len(out) == len(ROWS)
    c = out.dropna(subset="doc_id").drop_duplicates("doc_id").set_index("doc_id")["class_id"]
    assert c[1] == c[2] == 0 and c[5] == 4 and c[6] == 6 and c[7] == 7 and c[3] == 3 and c[10] == 10
    assert out[out.doc_id.isna()]["class_id"].isna().sum() == 1
    family = [(i, " ".join(w if RNG.random() > 0.004 else "edit" for w in BASE.split())) for i in range(60)] + [(100 + i, prose(150)) for i in range(40)]
    got = neardup.near_classes(spark.createDataFrame(family, "doc_id long, text string")).toPandas().set_index("doc_id")["class_id"]
    assert (got[got.index < 60] == 0).mean() > 0.9 and all(got[i] == i for i in range(100, 140))
    assert neardup.near_classes(none).count() == 0


def test_one_row_of_a_class_stays(spark, none):
    """By row, not by id: texts of one id are told apart, exact copies go whatever their ids, repeated rows leave one; columns of any name stay as they are."""
    a, b, c, d = prose(30), prose(30), prose(30), prose(30)
    rows = [(1, a), (3, a), (3, b), (7, c), (7, d), (None, c), (None, "no id"), (None, "no id"), (9, b), (4, None), (4, None), (5, None), (6, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, k, f"n{k}", {"k": k}) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _n long, _node string, _key map<string, long>")
    kept = neardup.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (3, b), (7, c), (7, d), (None, "no id"), (4, None), (5, None), (6, "")], key=str)
    assert all(r["_node"] == f"n{r['_n']}" and r["_key"] == {"k": r["_n"]} and rows[r["_n"]] == (r["doc_id"], r["text"]) for r in kept.collect())
    assert neardup.keep_one(none).count() == 0


def test_common_weights_of_blocks():
    vectors = []
    for _ in range(40):
        keys = np.sort(RNG.choice(60, RNG.integers(1, 50), replace=False)).astype(np.uint64)
        vectors.append((keys, RNG.integers(1, 6, len(keys)) * (keys.astype(np.int64) + 1)))
    left, right = vectors[:15] + [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], vectors[10:]
    same = np.arange(16)[:, None] == np.arange(10, 40)[None, :]
    got = neardup.common_weight(left, right, same, tile=7)
    for i, (a, wa) in enumerate(left):
        for j, (b, wb) in enumerate(right):
            if not same[i, j]:
                x, y = dict(zip(a.tolist(), wa.tolist())), dict(zip(b.tolist(), wb.tolist()))
                assert got[i, j] == sum(min(x[k], y[k]) for k in x.keys() & y.keys())


def test_full_buckets_lose_no_class(spark, monkeypatch):
    """Loose families: hubs reach a part of them only, the blocks of step 5 the rest, as comparing all pairs of every bucket does."""
    rows = []
    for f in range(3):
        base = prose(120).split()
        rows += [(100 * f + i, " ".join(w if RNG.random() > 0.02 else f"edit{RNG.integers(1 << 30)}" for w in base)) for i in range(70)]
    family = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "PART_ROWS", 16)
    classes = [neardup.near_classes(family, hubs=h).toPandas().set_index("doc_id")["class_id"].sort_index() for h in (1, 10**6)]
    assert classes[0].equals(classes[1]) and 3 < classes[0].nunique() < 210


def test_proximity_by_brute_force(spark):
    """Items with a word unseen in the corpus in every window, with repeated words and with fewer than two terms of the corpus; each row by its own text."""
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(VOCAB[:60], n)) for n in (5, 40, 40, 80, 200)]
    loose = VOCAB[100:109]
    texts += [f"{loose[0]} {' '.join(loose[1:])} end", f"{loose[0]} {' '.join(VOCAB[:30])} {loose[1]}", VOCAB[200], f"{VOCAB[201]} {VOCAB[202]}", None]
    items = [(f"r{i}", " ".join(rng.choice(VOCAB[:60], 14))) for i in range(8)]
    items += [(f"u{i}", " ".join([*rng.choice(VOCAB[:60], 5), "unseen", *rng.choice(VOCAB[:60], 4)])) for i in range(8)]
    items += [("loose", " ".join([*loose[:5], "unseen", *loose[5:]])), ("twice", f"{VOCAB[200]} unseen {VOCAB[200]}"), ("none", "not there"), ("close", f"{VOCAB[201]} {VOCAB[202]} unseen {VOCAB[202]}")]
    rows = [(i % 7, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    df = Counter(w for t in texts for w in (t or "").split())
    want = {}
    for item, text in items:
        words = text.split()
        rare = sorted({w for w in words if df[w]}, key=lambda w: (df[w], w))[:2]
        gap = lambda ws: min((abs(i - j) for i, a in enumerate(ws) if a == rare[0] for j, b in enumerate(ws) if b == rare[1]), default=None)  # noqa: B023, E731
        for row in rows if len(rare) == 2 else []:
            d = gap((row[1] or "").split())
            if d is not None and d <= gap(words) + decontamination.SLOP:
                want[(*row, item)] = d
    index = decontamination.Index(docs, spark.createDataFrame(items, "item_id string, text string"))
    near = decontamination.proximity_matches(index)
    key = {r["_key"]: r["text"] for r in decontamination.keyed(docs).collect()}
    assert {(r["doc_id"], key[r["_key"]], r["item_id"]): r["distance"] for r in near.collect()} == want
    assert {"loose", "close"} < {k[2] for k in want} and any(k[2].startswith("u") for k in want) and not {"twice", "none"} & {k[2] for k in want}
    out = decontamination.whole_report(decontamination.phrase_matches(docs, index), near).collect()
    digest = lambda row: hashlib.sha256(",".join(sorted(k[2] for k in want if k[:2] == row)).encode()).hexdigest()
    assert sorted((r["doc_id"], r["n_near"], r["near_sha256"]) for r in out) == sorted((row[0], sum(k[:2] == row for k in want), digest(row)) for row in rows)


def test_decontamination_equals_its_sql(spark):
    """Both kinds of match on repeated rows, ids with several texts, no id, short and wordless items, upper case beyond Z."""
    rng = np.random.default_rng(4)
    pick = lambda n: " ".join(rng.choice(VOCAB[:50], n))
    items = [(f"i{k}", pick(k % 25 + 1)) for k in range(30)] + [("i3", pick(12)), ("e", "\u00c9t\u00c9 B\u00e9"), ("n", None), ("w", "--"), (None, pick(12)), ("i5", f"{VOCAB[300]} unseen {VOCAB[301]}")]
    texts = [pick(60) for _ in range(8)] + [f"{pick(9)} {items[k][1].upper()} {pick(5)}" for k in range(5, 30, 3)] + ["\u00c9t\u00c9-b\u00c9, \u00c9t\u00c9 b\u00e9", None, "", f"{VOCAB[300]} {pick(3)} {VOCAB[301]}"]
    rows = [(i % 9 if i % 4 else None, t) for i, t in enumerate(texts)] + [(1, texts[1])] * 2
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    duck = duckdb.connect()
    duck.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    duck.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    want = duck.execute(decontamination.ORACLE).df()
    plain = lambda df: sorted(tuple(str(x).removesuffix(".0") for x in r) for r in df[sorted(want)].fillna(-1).itertuples(index=False))
    for most in (decontamination.BROADCAST_BYTES, -1):  # also as if nothing could be broadcast
        with pytest.MonkeyPatch.context() as m:
            m.setattr(decontamination, "BROADCAST_BYTES", most)
            index = decontamination.Index(docs, bench)
            got = decontamination.whole_report(decontamination.phrase_matches(docs, index), decontamination.proximity_matches(index)).toPandas()
        assert sorted(got) == sorted(want) and plain(got) == plain(want)
    assert (want.n_hit > 0).sum() > 3 and (want.n_near > 0).sum() > (want.n_items > 0).sum()


def test_pipeline_filters(spark, docs, none, monkeypatch):
    harsh = toxicity.Network()
    harsh.p["bo"][:] = 9  # calls everything toxic
    with monkeypatch.context() as m:
        m.setattr(toxicity, "train", lambda *a: harsh)
        kept = corpus_pipeline.drop_toxic(spark, docs, SF)
        assert kept.columns == docs.columns and sorted(str(r["text"]) for r in kept.collect()) == sorted(map(str, [None, None, "", "", " \t\n"]))
        m.setattr(toxicity, "train", lambda *a: toxicity.Network())
        assert corpus_pipeline.drop_toxic(spark, docs, SF).count() == len(ROWS)
    once = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    ids = Counter(r["doc_id"] for r in once.collect())
    assert once.columns == docs.columns and ids[0] == 1 and not ids[1] and not ids[2] and ids[3] == 1 and ids[None] == 1
    assert corpus_pipeline.drop_contaminated(spark, docs, SF).count() == len(ROWS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0 and (name == "sharding" or out.columns == none.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_pipeline_drops_contaminated_texts(spark, tmp_path):
    """Columns named like those that the stage adds keep their values."""
    spark.createDataFrame([("b1", PHRASE)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"x {PHRASE}", "k1"), (2, prose(30), "k2"), (None, PHRASE.upper(), "k3"), (2, "other", "k4"), (3, None, "k5")], "doc_id long, text string, _key string")
    out = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(r["_key"] for r in out.collect()) == ["k2", "k4", "k5"]


def test_pipeline_mixing_by_brute_force(spark, docs):
    """Each row as often as the mix takes it, repeated rows together; columns as they came."""
    more = docs.withColumn("_key", F.lit("own")).withColumn("_made", F.col("doc_id")).unionByName(docs.withColumn("_key", F.lit("own")).withColumn("_made", F.col("doc_id")).where("doc_id = 10"))
    out = corpus_pipeline.mix_sources(spark, more, SF)
    assert out.columns == more.columns
    mixed = mixing.mix_documents(mixing.sized(more, spark.read.parquet(f"{SF}/labels.parquet"), F.col("text"))).collect()
    want = Counter()
    for r in mixed:
        want[r["doc_id"], r["text"]] += r["epochs"] + r["picked"] if r["size"] else 1
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == +want
    assert all(r["_key"] == "own" and r["_made"] == r["doc_id"] for r in out.collect())


def test_pipeline_end_to_end(spark):
    """Every stage's rows follow from the stage before: what is dropped is toxic, a copy or contaminated, and the shards hold the mix."""
    out = corpus_pipeline.run(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), queries.toxicity_held_out())
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    score = network.scores([t or "" for _, t in rows])
    rows = [r for r, x in zip(rows, score) if not (r[1] or "").split() or x < 0.5]
    classes, _ = slow_classes(rows)
    rows = [r for r, (i, c) in zip(rows, classes) if i == c]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        if w := words(r["text"]):
            windows.setdefault(min(len(w), 10), set()).update(grams(w, min(len(w), 10)))
    rows = [(i, t) for i, t in rows if not any(own & grams(words(t), n) for n, own in windows.items())]
    assert {i for i, _ in rows} >= set(out.doc_id) and len(out) > 0
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken = Counter(out.doc_id)
    assert max(taken.values()) <= 2 and all(taken[i] == 1 for i, n in sizes.items() if not n)
    assert sum(sizes[i] * n for i, n in taken.items()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.1)
    assert len(set(source.values())) > 1
    per = out.groupby("shard").size()
    assert per.max() - per.min() <= 1 and all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_near_duplicates_sketch_in_little_memory():
    """A block of 4 MB takes a few times its size."""
    rng = np.random.default_rng(17)
    words = np.array(["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(5000)])
    texts = [" ".join(rng.choice(words, 600)) for _ in range(1160)]
    pdf = pd.DataFrame({"block": 0, "key": np.arange(len(texts)), "node": [str(i).encode() for i in range(len(texts))], "text": texts})
    sent = pd.DataFrame(neardup._sender(1)(pdf), columns=["kind", "part", "block", "keys", "counts"])
    answers = exchange._add_up(sent)
    sketch = neardup._sketcher(len(texts))
    sketch(pdf[:1], exchange._add_up(pd.DataFrame(neardup._sender(1)(pdf[:1]), columns=sent.columns)))  # tables that stay are made
    tracemalloc.start()
    out = sketch(pdf, answers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == len(texts) and peak < 30e6


def test_near_duplicates_count_a_word_once_in_each_text():
    """Words of one byte too, whose place in the list of texts may be any: none is lost or counted for another."""
    alike = [" ".join(chr(c) for c in b"abcxyz059" if (i + c) % 3) + f" w{i} w{i % 7}" * 2 for i in range(130)]
    apart = [f"w{i}" for i in range(130)]
    apart[97], apart[98] = "b", "a"
    for texts in (alike, apart):
        df = Counter(w for t in texts for w in set(t.split()))
        words = Words(list(df), NOT_ALNUM)
        known, counts = neardup._word_texts(texts)
        assert dict(zip(known.tolist(), counts.tolist(), strict=True)) == dict(zip(words.hash.tolist(), df.values(), strict=True))
    pdf = pd.DataFrame({"block": 0, "key": np.arange(len(apart)), "node": [str(i).encode() for i in range(len(apart))], "text": apart})
    answers = exchange._add_up(pd.DataFrame(neardup._sender(1)(pdf), columns=["kind", "part", "block", "keys", "counts"]))
    assert len(neardup._sketcher(len(apart))(pdf, answers)) == len(apart)


def test_near_duplicates_deal_whole_texts_by_size(spark, monkeypatch):
    """Tasks of a block's size, however few partitions the session has; batches by bytes too."""
    rng = np.random.default_rng(18)
    monkeypatch.setattr(neardup, "blocked", lambda rows, size: exchange.blocked(rows, size, 2000))
    few = spark.createDataFrame([(i, " ".join(rng.choice(VOCAB, 170))) for i in range(30)], "doc_id long, text string")
    kept = neardup.keep_one(few)
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(_node#\w+, _key#\w+, (\d+)\), REPARTITION_BY_NUM", kept._jdf.queryExecution().toString())]
    assert dealt and min(dealt) >= 15 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert kept.count() == 30
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= neardup.BATCH_BYTES

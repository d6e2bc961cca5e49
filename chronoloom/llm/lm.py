"""Language-model scoring by a weighted backoff automaton.

The model smooths n-grams by a Dirichlet prior on the shorter history: p(w|h) = (c(hw) + m p(w|h')) / (c(h) + m), with a mass m for
each length of h (MASSES; as many as the order less one), down to p(w) = (c(w) + 1) / (N + V + 1), where the end of a text counts as
a token and the last 1 stands for any unknown token. A text's first token follows a beginning that is no token.

As an automaton: a state for each history seen in training, an arc for each seen n-gram with its weight, and from each state
a failure arc to the state of the shorter history with the weight m / (c(h) + m). Reading a text from left to right, the scorer
keeps the state, follows failure arcs until an arc for the token exists, goes where that leads and adds the logarithms.

`Automaton` is that machine. It is built for a block of documents, of the states and arcs that its texts can touch, from the
counts that the whole corpus has of the block's own n-grams (exchange.py); all texts of the block are then read in step, a token of each
at a time. Nothing of the size of the vocabulary is collected or broadcast.

Words are known by 64 bits of a hash, longer n-grams by about 20 bits more than it takes to number the corpus' tokens: one
that never occurs is taken for another that does with a probability of about one in a million.

Edge cases: a null or empty text is its end token alone; unknown words get the mass of an unseen token; a null doc_id is in
training; repeated rows are counted and scored as rows of their own, with equal results (many equal ones are read once and weigh what they are); without any training token every probability
is 1/1 of the single unknown token, so scores are 0. Texts are read whole, however long. Only doc_id, text and the columns of
held_out are read, whatever others there are. Scores are rounded to 6 decimals. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import GOLDEN, Words, chunks, exact_ids, materialize, mix, repeated, split_repeats, text_totals
from .exchange import answer_of, blocked, count_exchange, send

#: Chosen on held-out texts of the test tables: of 5, 20, 60, 200 and 1, 4, 15, 60.
MASSES = (200.0, 15.0)
END, BEGIN = mix(np.array([1, 2], np.uint64))
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
COUNTED = f"{SCHEMA}, n long"


def key_bits(total_bytes: int) -> int:
    """Of the keys of n-grams of two words or more."""
    return min(64, max(32, math.ceil(math.log2(max(total_bytes, 1))) + 18))


class Grams:
    """The n-grams of some texts, each a beginning, its tokens and an end: for each order the sorted distinct keys, the number of the n-gram that ends at each place (-1: none)
    and one place of each."""

    def __init__(self, texts: list[str], order: int, bits: int):
        parts = [self._stream(texts[a:b]) for a, b in chunks(texts)] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        token, self.count = (np.concatenate(x) for x in zip(*parts, strict=True))  # count: tokens of each text with the end
        self.first = np.cumsum(self.count + 1) - self.count - 1  # of the beginning of each text
        depth = np.arange(len(token)) - np.repeat(self.first, self.count + 1)
        self.known, self.number, self.place = [], [], []
        key = token
        for n in range(1, order + 1):
            if n > 1:
                key = np.r_[key[:1], mix(key[:-1] * GOLDEN + token[1:])]
            use = np.flatnonzero(depth >= n - 1)
            known, place, number = np.unique(key[use] if n == 1 else key[use] >> np.uint64(64 - bits), return_index=True, return_inverse=True)
            whole = np.full(len(token), -1, np.int64)
            whole[use] = number
            self.known.append(known)
            self.number.append(whole)
            self.place.append(use[place])

    @staticmethod
    def _stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        w = Words(texts)
        last = np.cumsum(w.count + 2) - 1
        token = np.empty(int((w.count + 2).sum()), np.uint64)
        inside = np.ones(len(token), bool)
        inside[last] = inside[last - w.count - 1] = False
        token[inside], token[last], token[last - w.count - 1] = w.hash, END, BEGIN
        return token, w.count + 1


class Automaton:
    """States with weighted arcs and failure arcs for the n-grams of some texts: counts are of the n-grams of each order in the training, total and distinct of its tokens."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], total: int, distinct: int, masses: tuple[float, ...] = MASSES):
        order = len(masses) + 1
        self.words = len(grams.known[0])
        ends = np.searchsorted(grams.known[0], [END, BEGIN])
        counts = [np.asarray(c, np.float64) for c in counts]
        # State 0 has no history; those of one token come next, then of two, up to order - 1. Only those seen in training have a way in.
        offset = np.cumsum([1, *(len(k) for k in grams.known[: order - 1])])
        self.fail, self.fail_weight = np.zeros(offset[-1], np.int64), np.zeros(offset[-1])
        prior = (counts[0] + 1) / (total + distinct + 1)
        seen = counts[0] > 0
        state = np.where(seen & (np.arange(self.words) != ends[0]), 1 + np.arange(self.words), 0)  # nothing follows an end
        arcs = [(np.arange(self.words), np.log10(prior), state if order > 1 else np.zeros_like(state))]  # of state 0: any word
        for n, mass in enumerate(masses, 2):
            short, number, place = grams.number[n - 2], grams.number[n - 1], grams.place[n - 1]
            own = slice(offset[n - 2], offset[n - 1])  # the states that these n-grams begin from
            self.fail_weight[own] = np.log10(mass / (counts[n - 2] + mass))
            shorter = grams.number[n - 3][grams.place[n - 2]] if n > 2 else None
            self.fail[own] = offset[n - 3] + shorter if n > 2 else 0
            history = short[place - 1]
            prior = (counts[n - 1] + mass * prior[short[place]]) / (counts[n - 2][history] + mass)
            seen = np.flatnonzero(counts[n - 1] > 0)
            last = grams.number[0][place[seen]]
            target = offset[n - 1] + number[place[seen]] if n < order else offset[n - 2] + short[place[seen]]
            arcs.append(((offset[n - 2] + history[seen]) * self.words + last, np.log10(prior[seen]), np.where(last == ends[0], 0, target)))
        key, weight, target = (np.concatenate(x) for x in zip(*arcs, strict=True))
        by = np.argsort(key)
        self.key, self.weight, self.target = key[by], weight[by], target[by]
        self.start = int(1 + ends[1]) if order > 1 and self.words and counts[0][ends[1]] > 0 else 0

    def scores(self, grams: Grams) -> np.ndarray:
        """log10 probabilities of the texts with their ends, read from left to right, all in step."""
        out, by = np.zeros(len(grams.count)), np.argsort(-grams.count, kind="stable")
        first, left = grams.first[by] + 1, grams.count[by]
        state, score = np.full(len(by), self.start), np.zeros(len(by))
        for step in range(int(left[0]) if len(left) else 0):
            reading = np.searchsorted(-left, -step, side="left")  # texts of more tokens than `step`
            word = grams.number[0][first[:reading] + step]
            open_ = np.arange(reading)
            while len(open_):
                now = state[open_]
                want = now * self.words + word[open_]
                at = np.searchsorted(self.key, want)
                at[at == len(self.key)] = 0
                found = self.key[at] == want
                score[open_] += np.where(found, self.weight[at], self.fail_weight[now])
                state[open_] = np.where(found, self.target[at], self.fail[now])
                open_ = open_[~found]
        out[by] = score
        return out


def _sender(blocks: int, order: int, bits: int):
    def sender(pdf: pd.DataFrame) -> list[tuple]:
        grams = Grams(pdf["text"].tolist(), order, bits)
        rows = np.repeat(np.where(pdf["held_out"].to_numpy(bool), 0, pdf["n"].to_numpy()), grams.count + 1)  # of the training that a place stands for
        block, out = int(pdf["block"].iloc[0]), []
        for n, (known, number) in enumerate(zip(grams.known, grams.number, strict=True)):
            use = (rows > 0) & (number >= 0)
            count = np.bincount(number[use], weights=rows[use], minlength=len(known)).astype(np.int64)
            keep = known != BEGIN if n == 0 else slice(None)  # the beginning is no token
            out += send(block, known[keep], count[keep], blocks, n, 64 if n == 0 else bits)
        return out

    return sender


def _scorer(total: int, distinct: int, starts: int, masses: tuple[float, ...], bits: int):
    def score(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[x.split()[0] for x in COUNTED.split(", ")])
        grams = Grams(pdf["text"].tolist(), len(masses) + 1, bits)
        counts = [answer_of(answers, n) for n in range(len(masses) + 1)]
        counts[0] = np.insert(counts[0], np.searchsorted(grams.known[0], BEGIN), starts)
        machine = Automaton(grams, counts, total, distinct, masses)
        token = np.delete(grams.number[0], grams.first)
        base = np.log10((counts[0].astype(np.float64) + 1) / (total + distinct + 1))
        add = lambda x: np.add.reduceat(x, np.cumsum(grams.count) - grams.count)
        return pd.DataFrame(
            {"doc_id": exact_ids(pdf["doc_id"]), "held_out": pdf["held_out"].to_numpy(), "n_tokens": grams.count, "n_known": add((counts[0] > 0)[token].astype(np.int64)), "train_tokens": total, "base_score": add(base[token]).round(6), "score": machine.scores(grams).round(6), "n": pdf["n"].to_numpy()}
        )

    return score


def score_corpus(docs: DataFrame, held_out, masses: tuple[float, ...] = MASSES) -> DataFrame:
    """Scores of all texts of docs; held_out is the column that keeps a row out of the training. The texts are dealt to blocks twice, for the
    counts and for the scores, as the corpus-wide counts are written in between. The texts of a block are read in step, so the longest of them alone for its last part: its tokens each cost a step."""
    docs = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    starts, size = docs.where(~F.col("held_out")).count(), text_totals(docs)[1]
    bits = key_bits(size)
    once, equal = split_repeats(docs, "n")
    rows, blocks = blocked(once if equal is None else once.unionByName(equal), size)
    answers = count_exchange(rows, blocks, _sender(blocks, len(masses) + 1, bits), "lm-counts")
    total, distinct = answers.where("kind = 0").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_scorer(int(total), int(distinct), starts, masses, bits), COUNTED)
    return (scored if equal is None else repeated(materialize(scored, "lm-scores"), "n", "place")).select(*(x.split()[0] for x in SCHEMA.split(", ")))


#: CRC-32 of a short ASCII string, bit by bit.
_CRC = "xor(4294967295::UBIGINT, list_reduce(list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::UBIGINT), lambda a, b: list_reduce(range(0, 8)::UBIGINT[], lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END, xor(a, b)), 4294967295::UBIGINT))"
#: score_corpus() over documents, without the rows whose crc32(doc_id) mod 7 is 2 in training: the recurrence over tables of counts. ' b' and ' e' are no words.
ORACLE = rf"""
WITH ids AS (SELECT s, {_CRC} % 7 = 2 AS held FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(held, FALSE) AS held,
         list_concat([' b'], regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), [' e']) AS ws
  FROM documents LEFT JOIN ids ON s = CAST(doc_id AS VARCHAR)
), tok AS (SELECT r, held, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d
), seq AS (SELECT r, held, i, w, lag(w) OVER o AS w1, lag(w, 2) OVER o AS w2 FROM tok WINDOW o AS (PARTITION BY r ORDER BY i)
), c1 AS (SELECT w, count(*) AS c FROM tok WHERE NOT held GROUP BY 1
), c2 AS (SELECT w1, w, count(*) AS c FROM seq WHERE NOT held AND i >= 2 GROUP BY 1, 2
), c3 AS (SELECT w2, w1, w, count(*) AS c FROM seq WHERE NOT held AND i >= 3 GROUP BY 1, 2, 3
), n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c1 WHERE w <> ' b'
), p AS (
  SELECT r, i, coalesce(u.c, 0) > 0 AS known, n, (coalesce(u.c, 0) + 1) / (n + v + 1) AS p1, coalesce(h.c, 0) AS h1, coalesce(b.c, 0) AS b, coalesce(hh.c, 0) AS h2, coalesce(t.c, 0) AS t
  FROM seq CROSS JOIN n LEFT JOIN c1 u USING (w) LEFT JOIN c1 h ON h.w = seq.w1 LEFT JOIN c2 b ON b.w1 = seq.w1 AND b.w = seq.w LEFT JOIN c2 hh ON hh.w1 = seq.w2 AND hh.w = seq.w1
       LEFT JOIN c3 t ON t.w2 = seq.w2 AND t.w1 = seq.w1 AND t.w = seq.w WHERE i >= 2
), q AS (SELECT *, (b + {MASSES[0]} * p1) / (h1 + {MASSES[0]}) AS p2 FROM p
), sums AS (
  SELECT r, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, max(n) AS n, sum(log10(p1)) AS base, sum(log10(CASE WHEN i >= 3 THEN (t + {MASSES[1]} * p2) / (h2 + {MASSES[1]}) ELSE p2 END)) AS score FROM q GROUP BY 1
)
SELECT doc_id, held AS held_out, n_tokens, n_known, CAST(n AS BIGINT) AS train_tokens, round(base, 6) AS base_score, round(score, 6) AS score FROM d JOIN sums USING (r)
"""

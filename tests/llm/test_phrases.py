"""Collocations against counting everything."""

import re
from collections import Counter

import pytest

from assay.llm import phrases
from brute import lower


def brute(docs, least, cover, top):
    f, n = {}, Counter()
    for text, lang in docs:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for k in (1, 2, 3):
                own.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= cover * a for q, b in found.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (score, a, p, l, r) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("shards, size", [(2, 1 << 10), (3, 1 << 12), (2, 16 << 20)])
def test_against_counting(spark, sf, shards, size):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").repartition(5, "doc_id")
    rows = [(r.text, r.lang) for r in docs.collect()]
    got = phrases.collocations(docs, 4, 50, 300, shards=shards, size=size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 50, 300)


def test_odd_rows(spark, odd, empty):
    docs = odd.selectExpr("*", "case when doc_id > 5 then 'x' end as lang", "text as phrase", "1 as shard", "'k' as chunk", "3 as ids", "0 as a")
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert sorted(map(tuple, phrases.collocations(docs, 2, 50, 100).collect())) == brute(rows, 2, 50, 100)
    assert phrases.collocations(empty.selectExpr("*", "cast(null as string) as lang"), 2).count() == 0


def test_pieces_case_and_overlaps(spark):
    rows = [("A a A a! a\ta\x0bb. É é", "l")] * 3 + [("", "l"), (None, None), (" \t ", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, phrases.collocations(docs, 3, 50, 10).collect())) == brute(rows, 3, 50, 10)

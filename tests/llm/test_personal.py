"""Personal data: patterns as written, the field against enumeration, and what it adds."""

import hashlib
import itertools
import random
import re

import numpy as np

from assay.llm import personal
from assay.llm.shape_crf import Field

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                    "card": 16 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_patterns_on_made_texts():
    rng = random.Random(3)
    bits = ["@", ".", "a", "b-c", "1", "22", "255", "256", "4465758382889437", "+", "-", " ", "(", ")", "é", "a@b.c", "1.2.3.4", "+1 (499) 555-6503", "\n", "0", "_%", "007"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        own = [(personal.KINDS[k], len(text.encode()[:a].decode()), len(text.encode()[:b].decode())) for k, a, b in personal.base_spans(text.encode())]
        assert own == plain(text), text


def test_long_runs_take_linear_time():
    for unit in (b"1", b"a", b"1.", b"a@", b"+1 ", b"1 ", b"-"):
        personal.base_spans(unit * 400_000)


def test_whole_table(spark, docs, queries, sf):
    got = {r.doc_id: r for r in queries["op13_personal_data"](spark, sf).collect()}
    assert len(got) == len(docs)
    for d, text in docs:
        own, r = plain(text), got[d]
        assert r.base_sha256 == hashlib.sha256(joined(own).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(s[0] == k for s in own) for k in personal.KINDS]
        every = [s for s in r.spans.split(",") if s]
        assert set(joined([s]) for s in own) <= set(every)
        key = lambda s: (personal.KINDS.index(s.split(":")[0]), int(s.split(":")[1]))
        assert every == sorted(every, key=key)


def test_odd_rows(spark, odd, empty):
    more = odd.selectExpr("*", "text as personal", "1 as n_email", "'s' as spans")
    marked, name = personal.found(more, personal.fit(more))
    rows = marked.collect()
    assert name != "personal" and len(rows) == 12
    assert all(r[name].spans == "" and r[name].n_ip == 0 for r in rows if not r.text)
    assert personal.personal(empty).count() == 0


def test_the_field_adds_phones_without_a_country(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeiounstr") for _ in range(5))
    phone = lambda: f"({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
    rows = [(i, f"{word()} {word()} +1 {phone()} {word()} in {rng.randint(1, 99)} {word()} of {rng.randint(1900, 2020)}") for i in range(300)]
    rows += [(300, f"call é (212) 555-0187 now"), (301, "he has 12 of 1999 and 4465758382889438 left")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in personal.personal(df).collect()}
    assert got[300].spans == "phone:7:21" and got[300].n_phone == 0
    assert got[301].spans == ""
    assert all(got[i].n_phone == 1 and got[i].spans.count(",") == 0 for i in range(300))


def test_viterbi_and_likelihood_against_enumeration():
    rng = np.random.default_rng(1)
    sentences = [[b"a", b"1", b"+2"], [b"x1", b"a"], [b"(3)", b"1.2", b"q", b"a@b"]]
    field = Field(3, sentences)
    for w in (field.unary, field.pairs, field.bias):
        w += rng.normal(size=w.shape)
    field.unary[:, 0] = 0
    flat = field.numbers([w for s in sentences for w in s])
    first = np.array([True, False, False, True, False, True, False, False, False])
    lengths = np.array([3, 2, 4])
    scores = field.scores(flat, first)
    tags, at = field.viterbi(scores, lengths), 0
    grid, inside, gold = np.zeros((3, 4, 3)), np.arange(4) < lengths[:, None], rng.integers(0, 3, (3, 4))
    grid[inside] = scores
    value, single, double = field.likelihood(grid, inside, gold)
    total, pairs = 0.0, np.zeros((3, 3))
    for row, n in enumerate(lengths):
        own = scores[at : at + n]
        paths = list(itertools.product(range(3), repeat=int(n)))
        weigh = np.array([sum(own[i, t] for i, t in enumerate(p)) + sum(field.pairs[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert tuple(tags[at : at + n]) == paths[int(weigh.argmax())]
        chance = np.exp(weigh - np.logaddexp.reduce(weigh))
        total += np.log(chance[paths.index(tuple(gold[row, :n]))])
        for p, c in zip(paths, chance):
            for a, b in zip(p, p[1:]):
                pairs[a, b] += c
        assert np.allclose(single[row, 0], [sum(c for p, c in zip(paths, chance) if p[0] == t) for t in range(3)])
        at += n
    assert np.isclose(value, total) and np.allclose(double, pairs)

"""Collocations over all documents."""

from __future__ import annotations

from assay.llm import phrases
from assay.llm.registry import query, table

LEAST, COVER, TOP = 10, 50, 2000


def _score(l: str, r: str) -> str:
    return f"(1000000::hugeint * a * a) // ({l}::hugeint * {r})"


@query("op11_collocations", f"""
    with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
    w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from p),
    f as (select lang, k, array_to_string(g, ' ') as phrase, count(*) as a from (
      select lang, k, ws[i:i + k - 1] as g from (select lang, k, ws, unnest(range(1, len(ws) - k + 2)) as i from w, (values (1), (2), (3)) as s(k))) group by all),
    n as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
    c as (select lang, k, phrase, a, string_split(phrase, ' ') as ws from f where k > 1 and a >= {LEAST}),
    cover as (select lang, part, max(a) as over from (select lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) as part from c where k = 3) group by all),
    kept as (select c.* from c left join cover v on v.lang = c.lang and v.part = c.phrase where v.over is null or 100 * v.over < {COVER} * c.a),
    cuts as (select lang, phrase, a, j, array_to_string(ws[1:j], ' ') as x, array_to_string(ws[j + 1:], ' ') as y from (select *, unnest(range(1, k)) as j from kept)),
    scored as (select cuts.lang, cuts.phrase, cuts.a, j, l.a as l, r.a as r, ({_score('l.a', 'r.a').replace('* a * a', '* cuts.a * cuts.a')})::bigint as score
      from cuts join f l on l.lang = cuts.lang and l.phrase = x join f r on r.lang = cuts.lang and r.phrase = y),
    lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest qualify rank <= {TOP})
    select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang)
""")
def op11_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"), LEAST, COVER, TOP)

"""Reusable SQL fragments for the oracles."""


def histogram(src, keys, score="prob", y="y"):
    k = ", ".join(keys)
    return f"(select {k}, {score} as s, sum({y})::double as pos, sum(1-{y})::double as neg from {src} group by {k}, {score})"


def table(src, keys, score="prob", y="y"):
    k = ", ".join(keys)
    win = f"over (partition by {k} order by s desc rows between unbounded preceding and current row)"
    tot = f"over (partition by {k})"
    return (f"(select {k}, s, pos, neg, sum(pos) {win} as tp, sum(neg) {win} as fp, sum(pos) {tot} as p_total, sum(neg) {tot} as n_total"
            f" from {histogram(src, keys, score, y)})")


def ranking(src, keys, score="prob", y="y"):
    k = ", ".join(keys)
    return (f"(select {k}, case when sum(pos) > 0 and sum(neg) > 0 then sum(pos * ((n_total - fp) + neg / 2)) / (sum(pos) * sum(neg)) end as auroc,"
            f" case when sum(pos) > 0 then sum(pos * tp / (tp + fp)) / sum(pos) end as auprc, sum(pos)::bigint as n_pos, sum(neg)::bigint as n_neg"
            f" from {table(src, keys, score, y)} group by {k})")


def curve(src, keys, score="prob", y="y"):
    return (f"(select *, 2 * precision * recall / (precision + recall + 1e-12::double) as f1 from (select *, s as threshold, tp / (tp + fp) as precision,"
            f" case when p_total > 0 then tp / p_total end as recall, case when n_total > 0 then fp / n_total end as fpr from {table(src, keys, score, y)}))")


def best_f1(src, keys, score="prob", y="y"):
    k = ", ".join(keys)
    return (f"(select {k}, case when max(p_total) > 0 and max(n_total) > 0 then max(threshold) filter (where rn = 1) else 0.5::double end as threshold,"
            f" case when max(p_total) > 0 and max(n_total) > 0 then max(f1) filter (where rn = 1) end as best_f1"
            f" from (select *, row_number() over (partition by {k} order by f1 desc, threshold) as rn from {curve(src, keys, score, y)}) group by {k})")


def confusion(src, keys, score="prob", y="y", keep="true"):
    """src has a threshold column."""
    k = ", ".join(keys)
    return (f"(select {k}, count(*) filter (where {keep} and {score} >= threshold and {y} = 1) as tp, count(*) filter (where {keep} and {score} >= threshold and {y} = 0) as fp,"
            f" count(*) filter (where {keep} and {score} < threshold and {y} = 0) as tn, count(*) filter (where {keep} and {score} < threshold and {y} = 1) as fn,"
            f" count(*) filter (where not ({keep})) as n_excluded, max(threshold) as threshold from {src} group by {k})")


def points(counts):
    return (f"(select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0::double end as f1 from"
            f" (select *, case when tp + fp > 0 then tp::double / (tp + fp) else 0.0::double end as precision,"
            f" case when tp + fn > 0 then tp::double / (tp + fn) else 0.0::double end as recall,"
            f" case when tn + fp > 0 then tn::double / (tn + fp) else 0.0::double end as specificity from {counts}))")


def report(src, keys, score="prob", y="y", keep="true"):
    k = ", ".join(keys)
    on = ", ".join(keys)
    return (f"(select {k}, auroc, auprc, f1, precision, recall, specificity, coalesce(n_pos, 0) as n_pos, n_excluded, threshold"
            f" from {points(confusion(src, keys, score, y, keep))} left join {ranking(f'(select * from {src} where {keep})', keys, score, y)} using ({on}))")


def r9(*cols):
    return ", ".join(f"round({c}, 9) as {c}" for c in cols)

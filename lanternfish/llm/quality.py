"""Quality rules under weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule votes good (1), bad (-1) or abstains (0) on counts of the whole text. A rule that votes is right with an
unknown probability, its accuracy, whatever the class; an abstention is no evidence, so that no clean document is lost
for want of praise. Accuracies and the share of good documents are estimated by expectation-maximisation over the
counted vote patterns of all documents: at most 3 to the number of rules patterns reach the driver, however
many documents there are. The log-odds of the accuracies become one column expression, and a document stays if its
posterior probability of being good is at least a half.

Defined results: null and empty texts have no words and fail the base; repeated rows are judged alike; a posterior of just
a half keeps a document; a text of any length is counted whole, as one row; an empty table fits the prior and
returns no rows; other columns pass through, except that output names win over equal names of the input. Everything
on the documents is DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, let, marks, table, words

SYMBOLS = "#*$%&|<>"
#: What a text's characters are counted by.
COUNTED = r"#*$%&|<>!.?。\p{Lu}"
WINDOW = 8
ROUNDS = 100
#: The first guess of an accuracy counts as many votes, and an accuracy stays within these bounds.
FIRST_ACCURACY, FIRST_VOTES = 0.8, 10
LEAST, MOST = 0.5, 0.995

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_stops", "n_distinct"]


def _without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def repeat_words(tokens: Column) -> Column:
    """Words that lie in a window of eight words found twice or more in the text."""
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))

    def joined(h: Column, n: int) -> Column:
        """Hashes of runs of 2 * n words from those of n, at every word."""
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + n)))

    # by doubling: of two, four, then eight words; those that go beyond the text's end are cut off
    runs = let(let(let(hashes, lambda h: joined(h, 1)), lambda h: joined(h, 2)), lambda h: joined(h, 4))
    windows = F.slice(runs, 1, F.size(tokens) - (WINDOW - 1))

    def covered(wins: Column) -> Column:
        placed = F.array_sort(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            return F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))

        at = F.array_sort(F.transform(let(placed, again), lambda x: x["i"]))
        spans = let(at, lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x)

    some = let(windows, lambda wins: F.when(F.size(F.array_distinct(wins)) < F.size(wins), covered(wins)).otherwise(F.lit(0).cast("bigint")))
    return F.when(F.size(tokens) >= WINDOW, some).otherwise(F.lit(0).cast("bigint"))


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of STATS, all of the whole text; the text column stays."""
    names = ["_marks", "_words", "_lines"]
    made = {*STATS, *names}
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    rows = docs.select(*kept, marks(body, COUNTED).alias("_marks"), words(F.col(f"`{text}`")).alias("_words"), F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    t, w, lines = F.col("_marks"), F.col("_words"), F.col("_lines")
    stats = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.length(t) - _without(t, SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeat_words(w),
        "n_lines": F.size(lines),
        "n_upper": F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", "")),
        "n_exclaim": F.length(t) - _without(t, "!"),
        "n_stops": F.length(t) - _without(t, ".!?。"),
        "n_distinct": F.size(F.array_distinct(w)),
    }
    return rows.select(*kept, *[c.cast("bigint").alias(n) for n, c in stats.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Votes by rule, on the counts of STATS.

    Most rules know faults only. plain_letters praises, which tells the estimation what class most documents are of; it sees
    the facts of symbols and capitals again, so the three are not independent, and their accuracies come out high.
    """
    n, sym, up, excl = (F.col(c) for c in ("n_words", "n_symbols", "n_upper", "n_exclaim"))
    chars, stops, distinct = F.col("word_chars"), F.col("n_stops"), F.col("n_distinct")

    def vote(bad: Column | None, good: Column | None) -> Column:
        out = F.lit(0)
        if good is not None:
            out = F.when(good, 1).otherwise(out)
        return out if bad is None else F.when(bad, -1).otherwise(out)

    long_enough = n >= 20
    return {
        "symbols": vote(5 * sym > n, None),
        "capitals": vote(2 * up > chars, None),
        "exclamations": vote(5 * excl > n, None),
        "repeated_lines": vote(100 * F.col("n_dup_lines") > 30 * F.col("n_lines"), None),
        "repeated_words": vote(100 * F.col("n_repeat_words") > 30 * n, None),
        "word_length": vote((chars < 2 * n) | (chars > 15 * n), None),
        "plain_letters": vote((5 * sym > n) | (2 * up > chars), long_enough & (50 * sym <= n) & (5 * up <= chars) & (20 * excl <= n)),
        "sentences": vote(long_enough & ((150 * stops < n) | (stops > 2 * n)), None),
        "variety": vote(long_enough & (20 * distinct < n), None),
    }


def fit(stats: DataFrame) -> dict:
    """The accuracy of each rule, and the share of good documents."""
    votes = rules()
    names = list(votes)
    counted = stats.groupBy(*[c.cast("int").alias(n) for n, c in votes.items()]).agg(F.count("*").alias("_n")).collect()
    patterns = sorted(([r[n] for n in names], r["_n"]) for r in counted)
    accuracy, good, total = [FIRST_ACCURACY] * len(names), 0.5, sum(n for _, n in patterns)
    for _ in range(ROUNDS):
        post = [_sigmoid(_logit(good) + sum(v * _logit(a) for v, a in zip(p, accuracy))) for p, _ in patterns]
        before = [*accuracy, good]
        for j in range(len(names)):
            cast = sum(n for p, n in patterns if p[j])
            right = sum(n * (q if p[j] > 0 else 1 - q) for (p, n), q in zip(patterns, post) if p[j])
            accuracy[j] = min(max((right + FIRST_ACCURACY * FIRST_VOTES) / (cast + FIRST_VOTES), LEAST), MOST)
        good = min(max((sum(n * q for (_, n), q in zip(patterns, post)) + 1) / (total + 2), LEAST), MOST)
        if max(abs(x - y) for x, y in zip(before, [*accuracy, good])) < 1e-9:
            break
    return {"accuracy": dict(zip(names, accuracy)), "good": good, "documents": total}


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(min(z, 500.0), -500.0)))


def posterior_column(model: dict) -> Column:
    """The posterior probability that a document is good, from the counts of STATS."""
    z = F.lit(_logit(model["good"]))
    for name, vote in rules().items():
        z = z + vote * F.lit(_logit(model["accuracy"][name]))
    return 1 / (1 + F.exp(-z))


def judged(stats: DataFrame, model: dict) -> DataFrame:
    """Add base_failed, quality_prob and kept to rows with the counts of STATS."""
    out = stats.withColumn("base_failed", base_failed()).withColumn("quality_prob", posterior_column(model))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_prob") >= 0.5))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns.

    Texts are counted once: the documents with their counts go to a checkpoint, which the fit and the filter read.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").alias("_text"))
    stats = checkpointed(with_stats(whole, "_text").select("_doc", *STATS))
    return judged(stats, fit(stats.drop("_doc"))).where("kept").select("_doc.*")


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = checkpointed(with_stats(docs).drop("text"))
    out = judged(stats, fit(stats)).withColumn("quality_prob", F.round("quality_prob", 5))
    return out.select("doc_id", *STATS[:5], "base_failed", "kept", "quality_prob")


OP4_SQL = r"""
with recursive d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
win as (select r, i, md5(array_to_string(ws[i:i + 7], chr(0))) as h from w, unnest(range(1, len(ws) - 6)) as u(i) where len(ws) >= 8),
again as (select r, i, lead(i) over (partition by r order by i) as nxt from (select *, count(*) over (partition by r, h) as c from win) where c > 1),
rep as (select r, sum(least(8, coalesce(nxt - i, 8)))::bigint as n_repeat_words from again group by r),
s as (select r, doc_id, len(ws) as n, list_sum(list_transform(ws, lambda x: length(x))) as chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as sym, len(ls) - len(list_distinct(ls)) as dup, coalesce(n_repeat_words, 0) as rp,
    len(ls) as nl, len(regexp_extract_all(t, '\p{Lu}')) as up, len(regexp_extract_all(t, '!')) as ex, len(regexp_extract_all(t, '[.!?。]')) as st, len(list_distinct(ws)) as di from w left join rep using (r)),
f as (select r, doc_id, n, coalesce(chars, 0)::bigint as chars, sym, dup, rp, nl, up, ex, st, di from s),
v as materialized (select *, [case when 5 * sym > n then -1 else 0 end, case when 2 * up > chars then -1 else 0 end, case when 5 * ex > n then -1 else 0 end, case when 100 * dup > 30 * nl then -1 else 0 end,
    case when 100 * rp > 30 * n then -1 else 0 end, case when chars < 2 * n or chars > 15 * n then -1 else 0 end,
    case when 5 * sym > n or 2 * up > chars then -1 when n >= 20 and 50 * sym <= n and 5 * up <= chars and 20 * ex <= n then 1 else 0 end,
    case when n >= 20 and (150 * st < n or st > 2 * n) then -1 else 0 end, case when n >= 20 and 20 * di < n then -1 else 0 end] as votes from f),
p as materialized (select votes, count(*)::double as c from v group by votes),
em as (
  select 0 as i, list_transform(range(9), lambda x: 0.8::double) as acc, 0.5::double as good
  union all
  select i + 1, list_transform(range(1, 10), lambda j: least(greatest((list_sum(list_transform(q, lambda z: case when z.votes[j] = 0 then 0 when z.votes[j] > 0 then z.c * z.post else z.c * (1 - z.post) end)) + 8)
      / (list_sum(list_transform(q, lambda z: case when z.votes[j] = 0 then 0 else z.c end)) + 10), 0.5), 0.995)),
    least(greatest((list_sum(list_transform(q, lambda z: z.c * z.post)) + 1) / (list_sum(list_transform(q, lambda z: z.c)) + 2), 0.5), 0.995)
  from (select i, list({'votes': votes, 'c': c, 'post': 1 / (1 + exp(-(ln(good / (1 - good)) + list_sum(list_transform(range(1, 10), lambda j: votes[j] * ln(acc[j] / (1 - acc[j])))))))}) as q from em, p where i < 100 group by i)),
m as (select arg_max(acc, i) as acc, arg_max(good, i) as good from em),
j as (select v.*, 1 / (1 + exp(-(ln(good / (1 - good)) + list_sum(list_transform(range(1, 10), lambda k: votes[k] * ln(acc[k] / (1 - acc[k]))))))) as post, n < 20 or 100 * rp > 30 * n as failed from v, m)
select doc_id, n as n_words, chars as word_chars, sym as n_symbols, dup as n_dup_lines, rp as n_repeat_words, failed as base_failed, not failed and post >= 0.5 as kept, round(post, 5) as quality_prob from j
"""

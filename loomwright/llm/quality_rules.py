"""Quality rules as weak supervision (operator 10): rules vote or abstain, expectation-maximisation weighs them.

Everything is DataFrame functions. Each text is scanned once into a few counts; the counts become votes (1 good,
-1 bad, 0 no opinion); the votes are counted by pattern, of which there are at most 3 to the number of rules; and
the maximisation runs over that one row of patterns. No step needs the rows of a key together.

Each rule rests on a count of its own and votes for a text, against it, or not at all. Two accuracies are estimated for a
rule: how often it votes for the good texts on which it votes (``for``), and against the bad ones (``against``). So a rule that
speaks for nearly every text tells nothing, and one that is wrong about one kind of text isn't trusted there. The estimates
start from the votes themselves: a text that no rule speaks against is probably good, one that two or more do probably bad.
Beliefs about rules weigh as much as ``BELIEF`` votes, whatever the number of votes, so votes outweigh them wherever there are
any to speak of. Texts that fail the base rules are judged already and take no part in the estimates.

Cases: a null text has no words; a text without words fails the base rules and no rule votes on it; null ids stay
null; repeated rows are judged alike, one by one; an empty table gives no rows (the estimates then stay at their
start); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import WORD, let, materialise

SYMBOLS = "[#*$%&|<>]"
SPAN = 8  # words in a window
ROUNDS = 40
#: What is believed at first: most texts are good, and a rule that votes is mostly right. Weighs as much as so many texts or votes.
PRIOR, RIGHT, BELIEF = 0.8, 0.9, 2.0
#: Where the maximisation starts: the probability of a good text if none, one, or more rules speak against it.
START = (0.9, 0.5, 0.1)
#: A text is kept from this posterior on.
KEEP = 0.5


def _repeated(words: Column) -> Column:
    """Words that lie in a window of eight words whose text occurs twice or more.

    Windows are compared by a 64-bit hash, built from hashes of one, two and four words. Most texts repeat no four
    words and are done there. Only if a text has equal windows are they sorted by hash, to find where they are, and
    the union of their stretches is summed from the gaps between their starts.
    """

    def joined(hashes: Column, gap: int) -> Column:
        """Of each hash with that ``gap`` places on."""
        n = F.size(hashes) - gap
        return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, gap + 1, n), lambda x, y: F.xxhash64(x, y))

    def count(hashes: Column) -> Column:
        at = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def equal(rows: Column) -> Column:  # by hash and then place
            same = lambda row, j: F.coalesce(F.get(rows, j)["h"] == row["h"], F.lit(False))
            starts = F.array_sort(F.transform(F.filter(rows, lambda row, j: same(row, j - 1) | same(row, j + 1)), lambda row: row["i"]))
            return let(starts, lambda s: F.aggregate(F.transform(s, lambda p, j: F.least(F.coalesce(F.get(s, j + 1) - p, F.lit(SPAN)), F.lit(SPAN))), F.lit(0), lambda a, n: a + n))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(at, equal))

    def fours(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(joined(hashes, 4), count))

    hashed = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) <= SPAN, 0).otherwise(let(let(let(hashed, lambda h: joined(h, 1)), lambda h: joined(h, 2)), fours)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts that the rules look at; each text is split once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = let(F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    counts = let(
        F.regexp_extract_all("t", F.lit(WORD), 0),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            _repeated(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        ),
    )
    # Lower-case runs as one letter: what else is counted is looked for in what is left, about half the text.
    left = F.regexp_replace("t", r"\p{Ll}+", "a")
    among = lambda rest, pattern: F.regexp_count(rest, F.lit(pattern)).cast("long")
    signs = let(
        left,
        lambda r: let(
            F.regexp_replace(r, r"[a\x20\x09-\x0D]+", ""),
            lambda few: F.struct(
                among(few, SYMBOLS).alias("n_symbols"),
                among(few, r"\p{Lu}").alias("n_upper"),
                among(few, "[!?]").alias("n_marks"),
                among(few, "[.,;:]").alias("n_stops"),
                (F.length("t") - F.length(r) + F.length(r) - F.length(F.replace(r, F.lit("a"), F.lit(""))) + among(few, r"\p{L}")).cast("long").alias("n_letters"),
                among(r, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}\p{N}]+(?![^\x20\x09-\x0D])").alias("n_bare"),
            ),
        ),
    )
    found = split.select("doc_id", counts.alias("c"), lines.cast("long").alias("n_dup_lines"), signs.alias("s"))
    return found.select("doc_id", "c.*", "n_dup_lines", "s.*")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _share(count: str, of: str) -> str:
    return f"({count} * 100.0 / greatest({of}, 1))"


# When a rule speaks for a text and when against it, as conditions that Spark and DuckDB read alike. Each has its own count.
_SPEAKS = {
    "symbols": (f"{_share('n_symbols', 'n_words')} <= 2", f"{_share('n_symbols', 'n_words')} > 10"),
    "upper": (f"{_share('n_upper', 'word_chars')} <= 10", f"{_share('n_upper', 'word_chars')} > 30"),
    "marks": (f"{_share('n_marks', 'n_words')} <= 5", f"{_share('n_marks', 'n_words')} > 20"),
    "repeats": (f"{_share('n_repeat_words', 'n_words')} <= 2", f"{_share('n_repeat_words', 'n_words')} > 10"),
    "variety": (f"{_share('n_distinct', 'n_words')} >= 50", f"{_share('n_distinct', 'n_words')} < 30"),
    "lines": ("n_dup_lines = 0", f"{_share('n_dup_lines', 'n_words')} > 5"),
    "stops": (f"{_share('n_stops', 'n_words')} BETWEEN 3 AND 40", f"{_share('n_stops', 'n_words')} < 1"),
    "length": ("word_chars * 10 BETWEEN 35 * n_words AND 65 * n_words", "(word_chars > 7 * n_words OR word_chars < 3 * n_words)"),
    "bare": (f"{_share('n_bare', 'n_words')} <= 2", f"{_share('n_bare', 'n_words')} > 20"),
    "letters": (f"{_share('n_letters', 'word_chars')} >= 92", f"{_share('n_letters', 'word_chars')} < 80"),
}
RULES = tuple(_SPEAKS)


def _vote(rule: str) -> str:
    good, bad = _SPEAKS[rule]
    return f"CASE WHEN n_words = 0 THEN 0 WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END"


def votes() -> dict[str, Column]:
    """The rules' votes by name; a text without words gets none."""
    return {r: F.expr(_vote(r)) for r in RULES}


def _posterior(vote: dict[str, Column], state: Callable[[str], Column]) -> Column:
    """Probability of a good text, given rules that vote independently with these accuracies, by names ``prior``, ``for_..``, ``against_..``."""
    told = lambda r: F.when(vote[r] > 0, F.log(state(f"for_{r}") / (1 - state(f"against_{r}")))).when(vote[r] < 0, F.log((1 - state(f"for_{r}")) / state(f"against_{r}"))).otherwise(0.0)
    odds = reduce(lambda a, r: a + told(r), vote, F.log(state("prior") / (1 - state("prior"))))
    return 1 / (1 + F.exp(-odds))


def estimate(voted: DataFrame, rules: list[str], rounds: int = ROUNDS, belief: float = BELIEF) -> dict[str, float]:
    """The share of good texts and each rule's two accuracies: one row, from the counted vote patterns (at most 3 ** len(rules))."""
    counted = voted.groupBy(*rules).count().agg(F.sort_array(F.collect_list(F.struct(*rules, F.col("count").cast("double").alias("n")))).alias("patterns"))
    weighed = lambda q: F.transform("patterns", lambda p: F.struct(p["n"].alias("n"), q(p).alias("q"), *[p[r].alias(r) for r in rules]))
    # The mean of a Beta distribution after so many observations, of which so many agree.
    mean = lambda agreed, seen, share: (agreed + belief * share) / (seen + belief)

    def update(rows: Column) -> Column:
        total = lambda f: F.aggregate(rows, F.lit(0.0), lambda a, x: a + f(x))
        new = {"prior": mean(total(lambda x: x["n"] * x["q"]), total(lambda x: x["n"]), PRIOR)}
        for r in rules:
            good, bad = (lambda x: x["n"] * x["q"]), (lambda x: x["n"] * (1 - x["q"]))
            cast = lambda x, f, r=r: F.when(x[r] != 0, f(x)).otherwise(0.0)
            new[f"for_{r}"] = mean(total(lambda x, r=r, f=good: F.when(x[r] > 0, f(x)).otherwise(0.0)), total(lambda x, f=good, c=cast: c(x, f)), RIGHT)
            new[f"against_{r}"] = mean(total(lambda x, r=r, f=bad: F.when(x[r] < 0, f(x)).otherwise(0.0)), total(lambda x, f=bad, c=cast: c(x, f)), RIGHT)
        return F.struct(*[p.alias(r) for r, p in new.items()])

    def first(p: Column) -> Column:
        against = reduce(lambda a, b: a + b, (F.when(p[r] < 0, 1).otherwise(0) for r in rules))
        return F.when(against == 0, START[0]).when(against == 1, START[1]).otherwise(START[2])

    step = lambda state, _: let(weighed(lambda p: _posterior({r: p[r] for r in rules}, lambda name: state[name])), update)
    started = counted.withColumn("start", let(weighed(first), update))
    return started.select(F.aggregate(F.sequence(F.lit(2), F.lit(rounds)), F.col("start"), step).alias("s")).select("s.*").first().asDict()


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base verdict, posterior quality and ``kept`` for each document."""
    rules = votes()
    voted = materialise(measure(docs).withColumns(rules), "quality-votes")  # narrow: the texts are read once
    found = estimate(voted.where(~base_failed()), list(rules))
    posterior = _posterior({r: F.col(r) for r in rules}, lambda name: F.lit(found[name]))
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & (posterior >= KEEP)).alias("kept"), F.round(posterior, 6).alias("quality"),
    )


def oracle() -> str:
    """The same as DuckDB SQL: windows as rows, and a table for each round of the maximisation."""
    rules = list(RULES)
    cast = [f"{_vote(r)} AS {r}" for r in rules]
    told = lambda r: f"CASE WHEN v.{r} > 0 THEN ln(s.for_{r} / (1 - s.against_{r})) WHEN v.{r} < 0 THEN ln((1 - s.for_{r}) / s.against_{r}) ELSE 0 END"
    odds = " + ".join(["ln(s.prior / (1 - s.prior))", *map(told, rules)])
    mean = lambda agreed, seen, share: f"(coalesce({agreed}, 0) + {BELIEF} * {share}) / (coalesce({seen}, 0) + {BELIEF})"
    new = [f"{mean('sum(n * q)', 'sum(n)', PRIOR)} AS prior"]
    for r in rules:
        new.append(f"{mean(f'sum(n * q) FILTER ({r} > 0)', f'sum(n * q) FILTER ({r} <> 0)', RIGHT)} AS for_{r}")
        new.append(f"{mean(f'sum(n * (1 - q)) FILTER ({r} < 0)', f'sum(n * (1 - q)) FILTER ({r} <> 0)', RIGHT)} AS against_{r}")
    new = ", ".join(new)
    against = " + ".join(f"CAST({r} < 0 AS INTEGER)" for r in rules)
    states = [f"s1 AS MATERIALIZED (SELECT {new} FROM (SELECT *, CASE {against} WHEN 0 THEN {START[0]} WHEN 1 THEN {START[1]} ELSE {START[2]} END AS q FROM patterns))"]
    for k in range(1, ROUNDS):
        weighed = f"SELECT n, {', '.join(f'v.{r}' for r in rules)}, 1 / (1 + exp(-({odds}))) AS q FROM patterns v, s{k} s"
        states.append(f"s{k + 1} AS MATERIALIZED (SELECT {new} FROM ({weighed}))")
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM texts)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), covered AS (
  SELECT doc_id, CAST(sum(k) AS BIGINT) AS n FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS k FROM repeated) GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '[!?]')) AS n_marks, len(regexp_extract_all(t, '[.,;:]')) AS n_stops,
    len(regexp_extract_all(t, '\p{{L}}')) AS n_letters, len(list_filter(w, lambda x: NOT regexp_matches(x, '[\p{{L}}\p{{N}}]'))) AS n_bare,
    len(list_distinct(w)) AS n_distinct, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, coalesce(n, 0) AS n_repeat_words
  FROM texts LEFT JOIN covered USING (doc_id)
), votes AS MATERIALIZED (
  SELECT *, {", ".join(cast)} FROM (SELECT *, len(l) - len(list_distinct(l)) AS n_dup_lines FROM counts)
), patterns AS MATERIALIZED (
  SELECT {", ".join(rules)}, CAST(count(*) AS DOUBLE) AS n FROM votes WHERE NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) GROUP BY ALL
), {", ".join(states)}, judged AS (
  SELECT v.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 1 / (1 + exp(-({odds}))) AS p FROM votes v, s{ROUNDS} s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= {KEEP} AS kept, round(p, 6) AS quality FROM judged"""

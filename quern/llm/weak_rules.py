"""Quality rules as weak supervision, native throughout.

Rules vote good (1), bad (0) or abstain (null) on figures of the whole text. Expectation-maximisation
over the table of vote patterns (at most 3^rules rows, whatever the input) estimates the share of good
texts and each rule's rate of bad votes on good and on bad texts; the posterior of "good" then replaces
the all-must-pass filter. All figures of a text are computed inside its own row, without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import doc_texts, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
EM_ROUNDS, KEEP_AT = 50, 0.5
#: Where EM starts: the share of good texts, and how often a rule that votes calls good and bad texts bad.
START_GOOD, START_BAD_ON_GOOD, START_BAD_ON_BAD = 0.85, 0.01, 0.4
#: Rates stay this far from 0 and 1, so that no single rule is ever certain. To a rule's votes are added this
#: share of them as prior votes at the starting rates: rates lean to them alike at every size of the input.
FLOOR, PRIOR_SHARE = 1e-3, 0.02


def _repeat_words(w: str, hash_of: str = "xxhash64({w}[i], {w}[i + 1], {w}[i + 2])") -> str:
    """SQL: words of array w inside 3-word windows that occur twice or more.

    Windows are hashed and packed with their position into longs, which sort fast; neighbours of one hash
    are compared word by word, then the union of the windows' spans is measured from the gaps. In a text
    where two different windows have one (shortened) hash, the windows themselves are sorted instead.
    """
    at = lambda k, d: f"{w}[int(s.v[{k}] & s.m) + {d}]"
    near = lambda k: f"shiftright(s.v[j], s.b) = shiftright(s.v[{k}], s.b)"
    equal = lambda k: " and ".join(f"{at('j', d)} = {at(k, d)}" for d in range(3))
    clash = f"exists(sequence(1, size(s.v) - 1), j -> {near('j - 1')} and not ({equal('j - 1')}))"
    hashed = f"sort_array(transform(filter(sequence(0, size(s.v) - 1), j -> (j > 0 and {near('j - 1')}) or (j < size(s.v) - 1 and {near('j + 1')})), j -> int(s.v[j] & s.m)))"
    windows = f"sort_array(transform(sequence(0, size({w}) - 3), i -> struct({w}[i] as a, {w}[i + 1] as b, {w}[i + 2] as c, i as i)))"
    same = lambda k: " and ".join(f"x[j].{c} = x[{k}].{c}" for c in "abc")
    exact = f"transform(array({windows}), x -> sort_array(transform(filter(sequence(0, size(x) - 1), j -> (j > 0 and {same('j - 1')}) or (j < size(x) - 1 and {same('j + 1')})), j -> x[j].i)))[0]"
    union = "if(size(p) = 0, 0, 3 + aggregate(sequence(0, size(p) - 1), 0, (total, k) -> total + if(k = 0, 0, least(3, p[k] - p[greatest(k - 1, 0)]))))"
    packed = f"sort_array(transform(sequence(0, size({w}) - 3), i -> shiftleft({hash_of.replace('{w}', w)}, length(bin(size({w})))) | i))"
    bound = f"array(struct({packed} as v, length(bin(size({w}))) as b, shiftleft(1L, length(bin(size({w})))) - 1 as m))"
    return f"if(size({w}) < 4, 0, transform({bound}, s -> transform(array(if({clash}, {exact}, {hashed})), p -> {union})[0])[0])"


def rule_figures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the rules' own figures), all long."""
    one, word = "[^\\\\x20\\\\x09-\\\\x0D]", "([^\\\\x20\\\\x09-\\\\x0D]+)"
    texts = doc_texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Arrays are bound to lambda variables, so each is computed once per row.
    lengths = "aggregate(w, struct(0L as chars, 0 as short), (a, x) -> struct(a.chars + length(x) as chars, a.short + if(length(x) <= 3, 1, 0) as short))"
    of_words = f"struct(size(w) as n_words, {_repeat_words('w')} as n_repeat_words, {lengths} as l)"
    return texts.selectExpr(
        "doc_id",
        f"transform(array(regexp_extract_all(text, '{word}', 1)), w -> {of_words})[0] as w",
        f"regexp_count(text, '[{SYMBOLS}]') as n_symbols",
        "regexp_count(text, '\\\\p{Lu}') as n_upper",
        "regexp_count(text, '!') as n_exclaim",
        "regexp_count(text, '[^\\\\p{L}\\\\p{M}\\\\p{N}\\\\s.,;:\\'\"()-]') as n_marks",
        f"transform(array(filter(split(text, '\\n', -1), x -> x rlike '{one}')), x -> struct(size(x) as n, size(array_distinct(x)) as d))[0] as l",
    ).selectExpr(
        "doc_id", "bigint(w.n_words) as n_words", "bigint(w.l.chars) as word_chars", "bigint(n_symbols) as n_symbols",
        "bigint(l.n - l.d) as n_dup_lines", "bigint(w.n_repeat_words) as n_repeat_words", "bigint(l.n) as n_lines",
        "bigint(w.l.short) as n_short", "bigint(n_upper) as n_upper", "bigint(n_exclaim) as n_exclaim", "bigint(n_marks) as n_marks",
    )


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, else good where `good` holds, else abstains (SQL over rule_figures)."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 15 * n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0"),
    Rule("capitals", "100 * n_upper > 40 * word_chars", "100 * n_upper <= 15 * word_chars"),
    Rule("exclamations", "10 * n_exclaim > n_words", "50 * n_exclaim <= n_words"),
    Rule("short_words", "100 * n_short < 10 * n_words", "100 * n_short >= 20 * n_words"),
    Rule("marks", "10 * n_marks > 3 * n_words", "50 * n_marks <= n_words"),
)


def votes(figures: DataFrame, rules: tuple[Rule, ...] = RULES) -> Column:
    """One string of '1' (good), '0' (bad) and '-' (abstains), a digit for each rule; no words: all abstain."""
    one = lambda r: F.expr(f"case when n_words = 0 then '-' when {r.bad} then '0' when {r.good} then '1' else '-' end")
    return F.concat(*(one(r) for r in rules))


@dataclass(frozen=True)
class Accuracies:
    """What EM estimates: P(good), and per rule P(votes bad | good) and P(votes bad | bad) among its votes."""

    good: float
    bad_on_good: tuple[float, ...]
    bad_on_bad: tuple[float, ...]

    def log_odds(self, rule: int, vote: str) -> float:
        g, b = self.bad_on_good[rule], self.bad_on_bad[rule]
        return math.log((1 - g) / (1 - b)) if vote == "1" else math.log(g / b) if vote == "0" else 0.0

    def posterior(self, pattern: str) -> float:
        z = math.log(self.good / (1 - self.good)) + sum(self.log_odds(i, v) for i, v in enumerate(pattern))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def estimate(patterns: list[tuple[str, int]], rules: int = len(RULES), rounds: int = EM_ROUNDS) -> Accuracies:
    """EM over counted vote patterns. Without a pattern the starting values come back."""
    clip = lambda x: min(1 - FLOOR, max(FLOOR, x))
    now = Accuracies(START_GOOD, (START_BAD_ON_GOOD,) * rules, (START_BAD_ON_BAD,) * rules)
    patterns = sorted(patterns)
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        weighed = [(p, n, n * now.posterior(p)) for p, n in patterns]
        good = sum(g for *_, g in weighed)
        rates: tuple[list[float], list[float]] = ([], [])
        for i in range(rules):
            for out, share, start in ((rates[0], lambda n, g: g, START_BAD_ON_GOOD), (rates[1], lambda n, g: n - g, START_BAD_ON_BAD)):
                voted = sum(share(n, g) for p, n, g in weighed if p[i] != "-")
                bad = sum(share(n, g) for p, n, g in weighed if p[i] == "0")
                out.append(clip((bad / voted + PRIOR_SHARE * start) / (1 + PRIOR_SHARE)) if voted > 1e-9 else start)
        # A rule never counts against its own meaning: a bad vote is no sign of a good text.
        now = Accuracies(clip(good / total), tuple(rates[0]), tuple(max(g, b) for g, b in zip(*rates)))
    return now


def posterior(pattern: Column, found: Accuracies) -> Column:
    """The posterior quality probability as a native expression over the vote string."""
    z = F.lit(math.log(found.good / (1 - found.good)))
    for i in range(len(found.bad_on_good)):
        vote = F.substring(pattern, i + 1, 1)
        z = z + F.when(vote == "1", F.lit(found.log_odds(i, "1"))).when(vote == "0", F.lit(found.log_odds(i, "0"))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, and votes (a string) and posterior.

    base_failed: fewer than 50 words, or over half the words in repeated 3-word windows. kept is false
    if base_failed, else whether the posterior reaches keep_at. A null, empty or blank text has no words
    (all rules abstain, base_failed). Repeated rows and null doc_ids get a row each; an empty table gives
    none; other columns are ignored.
    """
    figures = rule_figures(docs)
    figures = written(figures.withColumn("votes", votes(figures, rules)), "rule-votes")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # At most 3^rules rows reach the driver.
    patterns = figures.groupBy("votes").count().collect()
    found = estimate([(r["votes"], r["count"]) for r in patterns], len(rules))
    return figures.withColumn("posterior", posterior(F.col("votes"), found)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("posterior") >= keep_at)).alias("kept"), "votes", "posterior",
    )

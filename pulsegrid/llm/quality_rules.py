"""Operator 1: quality rules with risk-controlled thresholds, in DataFrame functions only.

Base statistics are counts over each whole text. Each rule compares one statistic (per thousand, an
integer) with a cutoff; a document goes if any rule's statistic is above its cutoff. Cutoffs are
chosen for each stratum (a language) on labelled documents:

* For a rule, the cutoffs of a fixed grid are tested from the most lenient to the strictest. A cutoff
  passes if, were its true rate of rejecting good documents ``risk / rules`` or more, so few
  rejections among the stratum's good documents would have a chance of at most
  ``error / (strata * rules)``, by the exact binomial distribution (the Clopper-Pearson bound).
* Testing stops at the first failure (fixed-sequence testing), and the levels are split over all
  strata and rules (Bonferroni). So with probability 1 - ``error`` all passing cutoffs hold at once,
  and the rules lose at most the share ``risk`` of a stratum's good documents that pass the base rules.
* Of the cutoffs that passed, the one that rejects the most bad beyond good documents is taken, the
  most lenient on ties. A rule with none, or none that gains, is off in that stratum.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
OTHER = "other"


@dataclass(frozen=True)
class RuleSettings:
    """``grids``: cutoffs per thousand of each rule, the most lenient first. ``strata``: values of the

    stratum column with cutoffs of their own; all others and null share one stratum.
    """

    risk: float = 0.05
    error: float = 0.05
    strata: tuple[str, ...] = ("en", "de", "fr", "es")
    grids: dict[str, tuple[int, ...]] = field(
        default_factory=lambda: {
            "symbols": (3000, 2000, 1000, 500, 300, 200, 100, 50, 20),
            "upper": (800, 600, 500, 400, 300, 250, 200, 150, 100),
            "marks": (2000, 1500, 1000, 800, 600, 500, 400, 350),
            "repeats": (250, 200, 150, 100, 50, 20),
            "sameness": (950, 900, 850, 800, 750, 700, 650, 600, 550, 500),
        }
    )


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the array ``stat``: a struct of counts of each whole text. A null text is empty.

    The struct replaces a column of that name and all other columns stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keep = [c for c in docs.columns if c != "stat"]
    own = [F.col(f"`{c}`") for c in keep]
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: without(line, SPACES) != "")
    first = docs.select(
        F.struct(*own).alias("__row"),
        words.alias("__words"),
        lines.alias("__lines"),
        F.length(without(text, SPACES)).alias("__chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).alias("__symbols"),
        (F.length(text) - F.length(without(text, MARKS))).alias("__marks"),
        (F.length(text) - F.length(without(text, UPPER))).alias("__upper"),
    )
    n = F.size("__words")
    codes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(F.col("__words"), i, WINDOW)))).otherwise(F.array().cast("array<long>"))
    counts = [
        n.cast("long").alias("__n"),
        F.size(F.array_distinct("__words")).cast("long").alias("__distinct"),
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__dup_lines"),
    ]
    passed = ["__row", "__chars", "__symbols", "__marks", "__upper"]
    second = first.select(*passed, *counts, codes.alias("__codes"))
    passed += ["__n", "__distinct", "__n_lines", "__dup_lines"]
    pairs = F.array_sort(F.transform("__codes", lambda c, i: F.struct(c.alias("c"), i.alias("i"))))
    some = F.size("__codes") > F.size(F.array_distinct("__codes"))
    third = second.select(*passed, F.when(some, pairs).alias("__pairs"))
    code_at = lambda j: F.get(F.col("__pairs"), j)["c"]
    twice = F.filter("__pairs", lambda x, j: code_at(j - 1).eqNullSafe(x["c"]) | code_at(j + 1).eqNullSafe(x["c"]))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])
    fourth = third.select(*passed, F.coalesce(covered, F.lit(0)).cast("long").alias("__repeats"))
    as_long = lambda c: F.col(c).cast("long")
    stat = F.struct(
        as_long("__n").alias("n_words"),
        as_long("__chars").alias("word_chars"),
        as_long("__symbols").alias("n_symbols"),
        as_long("__dup_lines").alias("n_dup_lines"),
        as_long("__repeats").alias("n_repeat_words"),
        as_long("__marks").alias("n_marks"),
        as_long("__upper").alias("n_upper"),
        as_long("__distinct").alias("n_distinct"),
    )
    return fourth.select(*(F.col("__row")[c].alias(c) for c in keep), stat.alias("stat"))


def base_failed(stat: Column) -> Column:
    return (stat["n_words"] < 20) | (100 * stat["n_repeat_words"] > 30 * stat["n_words"])


def rule_values(stat: Column) -> dict[str, Column]:
    """Statistics per thousand, rounded down; 0 for a text without words."""
    share = lambda part, whole: F.when(whole > 0, F.floor(1000 * part / whole)).otherwise(0).cast("long")
    words = stat["n_words"]
    return {
        "symbols": share(stat["n_symbols"], words),
        "upper": share(stat["n_upper"], stat["word_chars"]),
        "marks": share(stat["n_marks"], words),
        "repeats": share(stat["n_repeat_words"], words),
        "sameness": share(words - stat["n_distinct"], words),
    }


def stratum(column: Column, settings: RuleSettings) -> Column:
    return F.when(column.isin(*settings.strata), column).otherwise(OTHER)


def log_gamma(x: Column) -> Column:
    """Stirling's series, ten places on, where it is exact to double precision."""
    x = x.cast("double")
    y = x + 10
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - F.log(reduce(lambda a, b: a * b, [x + i for i in range(10)]))


def chance_of_so_few(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) of a binomial X of n trials; 1 where k is at or above the mean.

    Terms are summed from k down; below the mean they fall fast, so ten deviations hold all of it.
    """
    log_term = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(rate)) + (n - k) * F.log1p(F.lit(-rate))
    terms = F.least(k, F.ceil(10 * F.sqrt(n * rate)) + 50)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] * (k - i + 1) / (n - k + i) * ((1 - rate) / rate)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    tail = F.when(terms >= 1, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(terms, F.lit(1)).cast("long")), start, add, lambda a: a["sum"])).otherwise(F.lit(1.0))
    return F.when((n == 0) | (k >= n * rate), F.lit(1.0)).otherwise(F.exp(log_term) * tail)


def choose_cutoffs(labelled: DataFrame, settings: RuleSettings) -> DataFrame:
    """stratum and ``cutoffs`` (map of rule to cutoff) from rows with stat, stratum and good (boolean)."""
    rules, strata = len(settings.grids), len(settings.strata) + 1
    values = rule_values(F.col("stat"))
    grid = {r: F.array(*(F.lit(c).cast("long") for c in g)) for r, g in settings.grids.items()}
    level = lambda r: F.size(F.filter(grid[r], lambda c: values[r] > c))  # noqa: E731  cutoffs that the statistic is above
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), level(r).alias("level"), F.lit(len(g)).alias("steps")) for r, g in settings.grids.items())))
    counted = labelled.select("stratum", "good", each.alias("x")).groupBy("stratum", "x.rule", "x.steps", "x.level").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # a statistic above `level` cutoffs is above the `level` strictest; step 1 is the most lenient
    steps = counted.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("steps"))))
    above = F.col("level") >= F.col("steps") - F.col("step") + 1
    tested = steps.groupBy("stratum", "rule", "step").agg(F.sum("good").alias("n"), F.sum(F.when(above, F.col("good")).otherwise(0)).alias("k"), F.sum(F.when(above, F.col("bad")).otherwise(0)).alias("bad"))
    passes = chance_of_so_few(F.col("k"), F.col("n"), settings.risk / rules) <= settings.error / (rules * strata)
    so_far = Window.partitionBy("stratum", "rule").orderBy("step")
    passed = tested.withColumn("ok", F.min(passes).over(so_far)).where("ok and bad > k")
    best = passed.groupBy("stratum", "rule").agg(F.max_by("step", F.struct(F.col("bad") - F.col("k"), -F.col("step"))).alias("step"))
    cutoff = F.coalesce(*(F.when(F.col("rule") == r, F.get(grid[r], F.col("step") - 1)) for r in settings.grids))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", cutoff.alias("cutoff")))).alias("cutoffs"))


def with_verdict(rows: DataFrame, cutoffs: DataFrame, settings: RuleSettings) -> DataFrame:
    """Rows (stat, stratum) with base_failed and kept. ``cutoffs`` has a row for each stratum at most, so it is broadcast."""
    values = rule_values(F.col("stat"))
    above = reduce(lambda a, b: a | b, [F.coalesce(values[r] > F.col("cutoffs")[r], F.lit(False)) for r in settings.grids])
    failed = base_failed(F.col("stat"))
    return rows.join(F.broadcast(cutoffs), "stratum", "left").withColumns({"base_failed": failed, "kept": ~failed & ~above})


def good_documents(labels: DataFrame) -> DataFrame:
    """doc_id and good: all of a document's labels are 1. Rows with a null id or label are left out."""
    rows = labels.where("doc_id is not null and quality is not null")
    return rows.groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, settings: RuleSettings = RuleSettings()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    Null and empty texts have no words and fail. Documents with a null id or language are judged with
    the stratum of other languages; repeated rows each get a row. Empty tables: without labels there
    are no cutoffs, and only the base rules decide. Statistics are written once to the shared folder
    (a row of counts for each document); both the choice and the verdicts read them there. A very long text is judged
    whole, as one row of one task. A document at a cutoff is kept: only what lies beyond it is rejected. Other columns,
    whatever their names, are left out.
    """
    from pulsegrid.llm.scratch import stored

    rows = base_statistics(docs.select(F.col("doc_id"), stratum(F.col("lang"), settings).alias("stratum"), F.col("text")))
    rows = stored(rows.drop("text"), "statistics")
    labelled = rows.join(good_documents(labels), "doc_id").where(~base_failed(F.col("stat")))
    judged = with_verdict(rows, choose_cutoffs(labelled, settings), settings)
    return judged.select("doc_id", *(F.col("stat")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def keep_good_documents(docs: DataFrame, labels: DataFrame, settings: RuleSettings = RuleSettings()) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they are, whatever their names.

    Documents with a null or empty text fail. Rows with a null id or language are judged with the
    stratum of other languages, repeated rows each by themselves, very long texts whole. An empty table
    stays empty; without labels only the base rules decide. Rows and statistics are written to the
    shared folder once: a filter on them would otherwise have Spark work them out again for each use.
    """
    from pulsegrid.llm.scratch import stored

    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), stratum(F.col("lang"), settings).alias("stratum"))
    rows = stored(base_statistics(whole, "row.text"), "statistics")
    labelled = rows.select(F.col("row.doc_id").alias("doc_id"), "stratum", "stat").join(good_documents(labels), "doc_id").where(~base_failed(F.col("stat")))
    judged = with_verdict(rows, choose_cutoffs(labelled, settings), settings)
    return judged.where("kept").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def sql(settings: RuleSettings = RuleSettings()) -> str:
    """The query over tables documents and labels, for DuckDB."""
    rules, strata = len(settings.grids), len(settings.strata) + 1
    share = lambda part, whole: f"case when {whole} > 0 then cast(floor(1000.0 * ({part}) / {whole}) as bigint) else 0 end"
    values = {
        "symbols": share("n_symbols", "n_words"),
        "upper": share("n_upper", "word_chars"),
        "marks": share("n_marks", "n_words"),
        "repeats": share("n_repeat_words", "n_words"),
        "sameness": share("n_words - n_distinct", "n_words"),
    }
    grid = ", ".join(f"('{r}', {i + 1}, {c})" for r, g in settings.grids.items() for i, c in enumerate(g))
    rate, level = settings.risk / rules, settings.error / (rules * strata)
    return f"""
with base as (
  select row_number() over () as r, doc_id, case when lang in ({", ".join(f"'{s}'" for s in settings.strata)}) then lang else '{OTHER}' end as stratum,
    coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines
  from documents),
windows as (
  select r, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') as w from (select r, words, unnest(range(1, len(words) - {WINDOW} + 2)) as i from base where len(words) >= {WINDOW})),
twice as (select r, i from (select r, i, count(*) over (partition by r, w) as n from windows) where n > 1),
repeated as (select r, count(distinct p) as n from (select r, unnest(range(i, i + {WINDOW})) as p from twice) group by r),
stats as (
  select b.r, doc_id, stratum, cast(len(words) as bigint) as n_words, cast(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(repeated.n, 0) as bigint) as n_repeat_words, length(regexp_replace(text, '[^.,;:!?]', '', 'g')) as n_marks,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper, len(list_distinct(words)) as n_distinct
  from base b left join repeated on b.r = repeated.r),
failed as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from stats),
rated as ({" union all ".join(f"select r, doc_id, stratum, base_failed, '{r}' as rule, {v} as value from failed" for r, v in values.items())}),
good as (select doc_id, min(quality) = 1 as good from labels where doc_id is not null and quality is not null group by doc_id),
grid(rule, step, cutoff) as (values {grid}),
tested as (
  select stratum, rated.rule, step, cutoff, count(*) filter (good) as n, count(*) filter (good and value > cutoff) as k, count(*) filter (not good and value > cutoff) as bad
  from rated join good using (doc_id) join grid on grid.rule = rated.rule where not base_failed group by all),
bound as (
  select *, case when n = 0 or k >= n * {rate!r} then 1.0 else list_sum(list_transform(range(0, k + 1),
    lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate!r}) + (n - i) * ln(1 - {rate!r})))) end as chance
  from tested),
passed as (select *, min(case when chance <= {level!r} then 1 else 0 end) over (partition by stratum, rule order by step) as ok from bound),
cutoffs as (select stratum, rule, cutoff from passed where ok = 1 and bad > k qualify row_number() over (partition by stratum, rule order by bad - k desc, step) = 1),
above as (select distinct r from rated join cutoffs using (stratum, rule) where value > cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and above.r is null as kept
from failed left join above on failed.r = above.r
"""

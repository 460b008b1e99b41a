"""Quality rules: a ledger of rule failures as bits, policies as masks over it, ablations by bitwise aggregation.

Every rule is evaluated once for a document. The ledger keeps the measurements and one ``long`` whose bit k says
that rule k failed. A policy is a named, versioned mask: it rejects a document if ``fail_bits & mask`` is not zero.
Changing a policy, comparing two, or asking what one rule costs reads the ledger and never the texts again.

Everything is DataFrame expressions over one row; the ledger needs no shuffle.

Defined results: a null or blank text has no words, fails ``min_words`` and is measured as zeros; a very long text is
measured whole, in n log n steps; repeated rows each get their own ledger row; an empty table gives an empty ledger;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import text as X

WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` takes a function that gives a measurement's column by its name."""

    bit: int
    name: str
    fails: Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule]) -> int:
        known = {r.name: r.bit for r in rules}
        return sum(1 << known[n] for n in self.rules)


RULES = (
    Rule(0, "min_words", lambda m: m("n_words") < 20),
    Rule(1, "repeated_windows", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    Rule(2, "symbol_ratio", lambda m: 10 * m("n_symbols") > 3 * m("n_words")),
    Rule(3, "duplicate_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule(4, "word_length", lambda m: (m("n_words") > 0) & ((m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words")))),
    Rule(5, "max_words", lambda m: m("n_words") > 1_000_000),
)
POLICIES = (
    Policy("base", 1, ("min_words", "repeated_windows")),
    Policy("strict", 1, ("min_words", "repeated_windows", "symbol_ratio", "word_length")),
    Policy("strict", 2, ("min_words", "repeated_windows", "symbol_ratio", "duplicate_lines", "word_length")),
)
DEFAULT = POLICIES[-1]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of eight that the text has at least twice.

    Windows are 64-bit hashes, built by doubling (1, 2, 4, 8 words). Only texts with a repeat sort them: equal hashes
    meet as neighbours, their starts are sorted again, and each start covers the words up to the next start, eight at
    most.
    """

    def doubled(hashes: Column, step: int) -> Column:
        return X.let(hashes, lambda h: F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - step, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + step))))

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            near = lambda i, by: F.coalesce(F.get(s, i + by)["h"], F.lit(None).cast("long"))
            again = lambda x, i: x["h"].eqNullSafe(near(i, 1)) | x["h"].eqNullSafe(near(i, -1))
            return F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"]))

        parts = X.let(X.let(by_hash, starts), lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        hashes = doubled(hashes, step)
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(
        X.let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    )


def measurements(text: Column) -> Column:
    """Struct of all that the rules look at."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(X.SPACES)) != "")

    def measured(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(t, X.SPACES, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            X.let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    return X.let(X.space_words(text), measured)


def fail_bits(measured: Callable[[str], Column], rules: Sequence[Rule] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(r.fails(measured), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def passes(bits: Column, policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, the measurements and ``fail_bits``, one row per row of ``docs``."""
    measured = docs.select("doc_id", measurements(F.col("text")).alias("m")).select("doc_id", "m.*")
    return measured.withColumn("fail_bits", fail_bits(F.col, rules))


def stored_ledger(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger, written to the shared folder and read back: policies and ablations read it, never the texts."""
    return scratch.materialize(ledger(docs, rules), "quality-ledger")


def apply_policy(ledger_rows: DataFrame, policy: Policy = DEFAULT, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return ledger_rows.withColumn("kept", passes(F.col("fail_bits"), policy, rules))


def ablations(ledger_rows: DataFrame, policy: Policy = DEFAULT, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy keeps without it.

    Documents are first counted by their masked bits, at most 2^rules rows, whatever the table's size; the rules are
    then judged on those counts.
    """
    mask = policy.mask(rules)
    counts = ledger_rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    spark = ledger_rows.sparkSession
    by_rule = spark.createDataFrame([(r.name, 1 << r.bit) for r in rules if mask >> r.bit & 1], "rule string, bit long")
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias
    return (
        counts.join(F.broadcast(by_rule))  # as many rows as the policy has rules
        .groupBy("rule")
        .agg(total(failed)("n_failed"), total(F.col("bits") == F.col("bit"))("n_only"), total(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0)("n_kept_without"))
        .withColumns({"policy": F.lit(policy.name), "version": F.lit(policy.version)})
    )


def keep(docs: DataFrame, policy: Policy = DEFAULT, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns: each row's ledger entry meets the mask."""
    name, bits = X.keep_columns(docs.columns, "_measured"), X.keep_columns(docs.columns, "_fail_bits")
    entries = docs.withColumn(name, measurements(F.col("text"))).withColumn(bits, fail_bits(lambda m: F.col(name)[m], rules))
    return entries.where(passes(F.col(bits), policy, rules)).drop(name, bits)


def report(docs: DataFrame) -> DataFrame:
    """The thin query: measurements, the contract's base rules, the default policy's verdict and every other policy's."""
    rows = apply_policy(ledger(docs))
    others = [passes(F.col("fail_bits"), p).alias(f"kept_{p.name}_{p.version}") for p in POLICIES]
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(F.col("fail_bits"), POLICIES[0])).alias("base_failed"), "kept", "fail_bits", "n_lines", *others)

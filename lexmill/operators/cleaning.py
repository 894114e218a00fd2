"""Deterministic cleaning: a configuration compiled into one chain of projections.

Each rule is one named column; the next rule reads it, so no expression is repeated.
Events are gathered in an array as the text goes through the rules. No shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .records import ProcessingError


@dataclass(frozen=True)
class Templates:
    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    lines: tuple[str, ...] = ()
    blocks: tuple[tuple[str, str], ...] = ()

    def markers(self) -> list[str]:
        return [m for m in (*self.prefixes, *self.suffixes, *self.lines, *(b[0] for b in self.blocks)) if m]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    priority: int
    action: str
    match_method: str
    reason_code: str


#: The known rules in their usual order: fixed values.
RULES = (
    Rule("remove_script_style", 10, "remove", "structural", "script_style_block"),
    Rule("normalize_html", 20, "normalize", "parser", "html_structure_or_entity"),
    Rule("remove_zero_width", 30, "remove", "unicode", "zero_width_character"),
    Rule("normalize_nfkc", 40, "normalize", "unicode", "unicode_nfkc"),
    Rule("normalize_whitespace", 50, "normalize", "structural", "whitespace"),
    Rule("remove_exact_templates", 60, "remove", "exact", "known_template"),
    Rule("flag_empty", 70, "flag", "structural", "empty_text"),
    Rule("flag_pure_symbol", 71, "flag", "structural", "pure_symbol_text"),
    Rule("flag_short", 72, "flag", "structural", "short_text"),
)


@dataclass(frozen=True)
class CleaningConfig:
    templates: Templates = Templates()
    rules: tuple[Rule, ...] = RULES
    short_text_threshold: int = 6
    algorithm_version: str = "deterministic-clean-v1"
    rule_version: str = "1.0.0"
    schema_version: str = "cleaning-config-v1"
    extra: dict = field(default_factory=dict)

    def ordered(self) -> list[Rule]:
        if self.schema_version != "cleaning-config-v1" or not self.rules:
            raise ProcessingError("invalid_cleaning_config", "schema_version or rules")
        if len({r.priority for r in self.rules}) != len(self.rules):
            raise ProcessingError("duplicate_priority", "rule priorities must differ")
        if any(r.match_method == "fuzzy" for r in self.rules):
            raise ProcessingError("fuzzy_not_supported", "fuzzy rules belong to fuzzy cleaning")
        unknown = {r.rule_id for r in self.rules} - {r.rule_id for r in RULES}
        if unknown:
            raise ProcessingError("unknown_cleaning_rule", ", ".join(sorted(unknown)))
        return sorted(self.rules, key=lambda r: r.priority)

    @classmethod
    def from_dict(cls, d: dict) -> CleaningConfig:
        t = d["exact_templates"]
        templates = Templates(tuple(t["prefixes"]), tuple(t["suffixes"]), tuple(t["lines"]), tuple((b["start"], b["end"]) for b in t["blocks"]))
        rules = tuple(Rule(r["rule_id"], r["priority"], r["action"], r["match_method"], r["reason_code"]) for r in d["rules"])
        return cls(templates, rules, d["short_text_threshold"], d["algorithm_version"], d["rule_version"], d["schema_version"])


def remove_templates(df: DataFrame, column: str, t: Templates) -> DataFrame:
    """``column`` without the known templates; ``_spans`` lists what was removed, in order."""
    df = df.withColumn("_spans", F.expr("cast(array() as array<string>)"))
    text, spans = F.col(column), F.col("_spans")

    def apply(hit: Column, rest: Column, span: Column) -> None:
        nonlocal df
        df = df.select(*(c for c in df.columns if c not in (column, "_spans")), F.when(hit, rest).otherwise(text).alias(column), F.concat(spans, F.when(hit, F.array(span)).otherwise(F.expr("cast(array() as array<string>)"))).alias("_spans"))

    for p in t.prefixes:
        apply(text.startswith(p), text.substr(F.lit(len(p) + 1), F.length(text)), F.lit(p))
    for s in t.suffixes:
        if s:  # an empty template removes nothing
            apply(text.endswith(s), text.substr(F.lit(1), F.length(text) - len(s)), F.lit(s))
    if t.lines:
        parts = F.split(text, "\n")
        df = df.select(
            *(c for c in df.columns if c not in (column, "_spans")),
            F.array_join(F.filter(parts, lambda x: ~x.isin(list(t.lines))), "\n").alias(column),
            F.concat(spans, F.filter(parts, lambda x: x.isin(list(t.lines)))).alias("_spans"),
        )
    for start, end in t.blocks:
        a = F.instr(text, start)
        b = F.call_function("locate", F.lit(end), text, a + len(start))
        apply((a > 0) & (b > 0), F.concat(text.substr(F.lit(1), a - 1), text.substr(b + len(end), F.length(text))), text.substr(a, b + len(end) - a))
    return df.withColumn(column, T.strip(text))


def clean(records: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    """Records with ``clean_text`` set and ``events``, an array of the rules' events in order."""
    df = records.withColumn("_t", F.col("raw_text"))
    empty = "cast(array() as array<struct<rule_id:string,priority:int,action:string,match_method:string,reason_code:string,decision:string,matched_span:string,removed_chars:int,score:double,rule_version:string,algorithm_version:string,metrics:struct<priority:int>,before_hash:string,after_hash:string>>)"
    none = F.expr(empty)  # read once in each step: an expression used twice would double with every rule
    df = df.withColumn("_events", none)

    def event(r: Rule, before: Column, after: Column, decision: str, span: Column) -> Column:
        removed = F.greatest(F.lit(0), F.length(before) - F.length(after))
        return F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.priority).alias("priority"), F.lit(r.action).alias("action"), F.lit(r.match_method).alias("match_method"), F.lit(r.reason_code).alias("reason_code"),
            F.lit(decision).alias("decision"), span.cast("string").alias("matched_span"), removed.cast("int").alias("removed_chars"), F.lit(1.0).alias("score"), F.lit(config.rule_version).alias("rule_version"), F.lit(config.algorithm_version).alias("algorithm_version"),
            F.struct(F.lit(r.priority).alias("priority")).alias("metrics"), T.sha256_text(before).alias("before_hash"), T.sha256_text(after).alias("after_hash"),
        )

    simple = {"remove_script_style": T.remove_script_style, "normalize_html": T.normalize_html, "remove_zero_width": T.remove_zero_width, "normalize_nfkc": T.nfkc, "normalize_whitespace": T.normalize_whitespace}
    for r in config.ordered():
        text, events = F.col("_t"), F.col("_events")
        if r.action == "flag":
            blank = T.is_blank(text)
            hit = {"flag_empty": blank, "flag_pure_symbol": ~blank & ~text.rlike(r"[\p{L}\p{N}]"), "flag_short": ~blank & (F.length(text) < config.short_text_threshold)}[r.rule_id]
            df = df.withColumn("_events", F.concat(events, F.when(hit, F.array(event(r, text, text, "review", F.lit(None)))).otherwise(none)))
            continue
        if r.rule_id == "remove_exact_templates":
            df = remove_templates(df.withColumn("_new", text), "_new", config.templates)
            span = F.when(F.size("_spans") > 0, F.array_join("_spans", ";"))
        else:
            df = df.withColumn("_new", simple[r.rule_id](text))
            codes = F.array_join(F.array_compact(F.array(*(F.when(text.contains(z), f"U+{ord(z):04X}") for z in sorted(T.ZERO_WIDTH)))), ",")
            span = {"remove_script_style": F.lit("script/style"), "remove_zero_width": codes}.get(r.rule_id, F.lit(None))
        new = F.col("_new")
        df = df.withColumn("_events", F.concat(events, F.when(new != text, F.array(event(r, text, new, "applied", span))).otherwise(none))).withColumn("_t", new).drop("_new", "_spans")
    return df.withColumn("clean_text", F.col("_t")).withColumn("events", F.col("_events")).drop("_t", "_events")


def cleaning_events(cleaned: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per event, with its place in the record's chain; ``keep`` names columns of the record that stay."""
    # outer: else the optimiser puts a filter on the array below all rules, and so computes each rule again and again
    rows = cleaned.select(*keep, "record_id", F.posexplode_outer("events").alias("seq", "e")).where("seq is not null").select(*keep, "record_id", "seq", "e.*")
    return rows.withColumn("stage", F.lit("deterministic_cleaning")).withColumn("schema_version", F.lit("cleaning-event-v1"))


def sampled_pairs(sampled: DataFrame, config: CleaningConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """Before and after of sampled records. Cleaning is row-local, so the sample is cleaned itself: no join. ``keep`` names columns that stay."""
    done = clean(sampled, config)
    return done.select(*keep, "record_id", F.col("raw_text").alias("before"), F.col("clean_text").alias("after"), (F.col("raw_text") != F.col("clean_text")).alias("changed"), T.changed_characters(F.col("raw_text"), F.col("clean_text")).alias("changed_characters"), F.transform("events", lambda e: e["rule_id"]).alias("rule_ids"))

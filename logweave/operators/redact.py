"""PII redaction as a fold of native Column layers.

Layer order is fixed: base64 truncation → phone → email → IP → card → CN id →
org code → JSON name fields → person names → user patterns. Each layer sees
the output of the one before. The row state is a struct: the text, the
detected names, and whether anything was rewritten.

A layer runs its pattern once over a text: the replacement carries a marker
character, and a text with a marker was hit. (Texts that hold the marker
themselves are tested first and rewritten then.) Cheap tests stand before the
patterns: an ``@`` for emails; one scan for the digits that all five number
entities need; for user patterns, the literals they need, all in one scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import (
    MARK,
    any_literal,
    has_match,
    jre,
    mask_value,
    needed_literal,
    quote_replacement,
    sub_matches,
    token_value,
    usable_pattern,
)
from .persons import person_names


@dataclass
class _Rule:
    literal: str | None  # fixed replacement text, or
    fn: Callable[[Column], Column] | None  # a function of the matched text


def _need_key(key: str | None) -> str:
    if not key:
        raise ValueError("pseudonymisation needs RedactionConfig.secret_key")
    return key


def _rule(rewrite: C.Rewrite, key: str | None) -> _Rule:
    match rewrite:
        case C.Replace(label):
            return _Rule(label, None)
        case C.Remove():
            return _Rule(C.REDACTED_TEXT, None)
        case C.Mask(head, tail, char):
            return _Rule(None, lambda v: mask_value(v, head, tail, char))
        case C.Token(prefix):
            key = _need_key(key)
            return _Rule(None, lambda v: token_value(v, key, F.lit(prefix)))
    raise ValueError(f"unknown rewrite {rewrite!r}")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, whatever Catalyst inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _base64_note(v: Column) -> Column:
    head, tail = C.BASE64_NOTE.split("{n}")
    return F.concat(F.left(v, F.lit(C.BASE64_KEEP)), F.lit(head), F.length(v).cast("string"), F.lit(tail))


def json_name_pattern() -> str:
    keys = "|".join(C.JSON_NAME_KEYS)
    return jre(f'("(?:{keys})"\\s*:\\s*")({C.JSON_NAME_VALUE})(?=")')


def _state(t: Column, d: Column, changed: Column) -> Column:
    return F.struct(t.alias("t"), d.alias("d"), changed.alias("changed"))


def _hit(x: Column, text: Column, name: Column | None) -> Column:
    return _state(text, x["d"] if name is None else F.array_append(x["d"], name), F.lit(True))


def _between(parts: Column, fn: Callable[[Column], Column]) -> Column:
    """Texts cut at the marker: every other part is a match and goes through ``fn``."""
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.coalesce(fn(p), F.lit(""))).otherwise(p)), "")


def _pattern_layer(x: Column, pattern: Column, rule: _Rule, name: Column | None, before: str = "", match: str = "$0") -> Column:
    """One pattern over the state: ``match`` (a group of it, behind group ``before``) is rewritten."""
    text = x["t"]
    if rule.literal is not None:
        marked = F.regexp_replace(text, pattern, F.lit(before + MARK + quote_replacement(rule.literal)))
        once = _let(marked, lambda r: F.when(r.contains(MARK), _hit(x, F.replace(r, F.lit(MARK), F.lit("")), name)).otherwise(x))
        again = F.regexp_replace(text, pattern, F.lit(before + quote_replacement(rule.literal)))
    else:
        cut = F.split(F.regexp_replace(text, pattern, F.lit(before + MARK + match + MARK)), MARK, -1)
        once = _let(cut, lambda p: F.when(F.size(p) > 1, _hit(x, _between(p, rule.fn), name)).otherwise(x))
        if before:
            head = lambda v: F.call_function("regexp_extract", v, F.concat(F.lit("(?s)^"), pattern), F.lit(1))
            # the look-ahead behind a match is lost with it: a quote stands in
            again = sub_matches(text, pattern, lambda v: _let(head(F.concat(v, F.lit('"'))), lambda h: F.concat(h, rule.fn(F.substring(v, F.length(h) + 1, F.length(v))))))
        else:
            again = sub_matches(text, pattern, rule.fn)
    slow = F.when(F.coalesce(F.rlike(text, pattern), F.lit(False)), _hit(x, again, name)).otherwise(x)
    return F.when(text.contains(MARK), slow).otherwise(once)


def _persons_rewrite(text: Column, names: Column, rule: _Rule) -> Column:
    # longest name first, then alphabetical: a deterministic order for overlaps
    ordered = F.array_sort(
        names,
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(
            F.when(a < b, -1).when(a > b, 1).otherwise(0)
        ),
    )
    if rule.literal is not None:
        return F.aggregate(ordered, text, lambda acc, n: F.replace(acc, n, F.lit(rule.literal)))
    return F.aggregate(ordered, text, lambda acc, n: F.replace(acc, n, rule.fn(n)))


def _fold_patterns(state: Column, patterns: list[tuple[C.Pattern, str]], key: str | None) -> Column:
    """User patterns with a literal each, as one loop over a table of them.

    A text that holds none of the literals leaves at the one scan for all of
    them; in the loop, a pattern is compiled and run only on a text that
    holds its own. Once a text was rewritten, every literal is looked for.
    """
    if any(isinstance(p.rule, C.Token) for p, _ in patterns):
        key = _need_key(key)

    def row(p: C.Pattern, literal: str) -> Column:
        rule = p.rule
        fixed = rule.label if isinstance(rule, C.Replace) else C.REDACTED_TEXT if isinstance(rule, C.Remove) else None
        mask = rule if isinstance(rule, C.Mask) else C.Mask()
        fields = {
            "name": F.lit(p.name), "regex": F.lit(jre(p.regex)), "literal": F.lit(literal), "fixed": F.lit(fixed).cast("string"),
            "prefix": F.lit(rule.prefix if isinstance(rule, C.Token) else None).cast("string"),
            "head": F.lit(mask.head), "tail": F.lit(mask.tail), "char": F.lit(mask.char),
        }
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    def step(x: Column, r: Column) -> Column:
        rewrite = lambda v: F.coalesce(
            r["fixed"],
            F.when(r["prefix"].isNotNull(), token_value(v, key, r["prefix"]) if key else F.lit(None).cast("string")),
            mask_value(v, r["head"], r["tail"], r["char"]),
        )
        return F.when(x["t"].contains(r["literal"]), _pattern_layer(x, r["regex"], _Rule(None, rewrite), r["name"])).otherwise(x)

    table = F.array(*[row(p, literal) for p, literal in patterns])
    some = any_literal([literal for _, literal in patterns])
    return _let(state, lambda x: F.when(x["changed"] | has_match(x["t"], some), F.aggregate(table, x, step)).otherwise(x))


def redact(
    df: DataFrame,
    text_col: str = "msg",
    cfg: C.RedactionConfig | None = None,
    *,
    out_col: str | None = None,
    detected_col: str = "detected",
    persons_col: str | None = None,
    part: str = "all",
) -> DataFrame:
    """Redact ``text_col``; add ``out_col`` (default: overwrite) and ``detected_col``.

    ``detected_col`` is the ordered, de-duplicated list of entity names found.
    ``persons_col`` (``array<string>``) names the person names found in each
    row, e.g. from :func:`logweave.operators.persons.person_names`. ``part``
    ``"before_names"`` stops in front of that layer, ``"from_names"`` goes on
    from there with the detected list it finds (see :func:`redact_names`).
    """
    if part not in ("all", "before_names", "from_names"):
        raise ValueError(f"unknown part {part!r}")
    head, tail = part != "from_names", part != "before_names"
    cfg = cfg or C.RedactionConfig()
    out_col = out_col or text_col
    key = cfg.secret_key
    st = "__lw_state"
    known = F.array().cast("array<string>") if head else F.col(detected_col)
    # what an earlier part may have rewritten is not known: as if it had
    cur = df.withColumn(st, _state(F.col(text_col), known, F.lit(not head)))

    def add(layer: Callable[[Column], Column]) -> None:
        nonlocal cur
        cur = cur.withColumn(st, _let(F.col(st), layer))

    def pattern(regex: str, rule: _Rule, name: str | None, gate: Callable[[Column], Column] | None = None, **groups: str) -> Callable[[Column], Column]:
        def layer(x: Column) -> Column:
            out = _pattern_layer(x, F.lit(regex), rule, F.lit(name) if name else None, **groups)
            return out if gate is None else F.when(gate(x), out).otherwise(x)

        return layer

    if cfg.truncate_base64 and head:
        add(pattern(jre(C.FAST_FORMS["BASE64"]), _Rule(None, _base64_note), None))

    if head:
        numbers = [e for e in C.NUMBER_ENTITIES if e in cfg.rules]
        if len(numbers) > 1:
            cur = cur.withColumn("__lw_numbers", has_match(F.col(st)["t"], jre(C.NUMBER_GATE)))
        for entity in C.REGEX_ENTITIES:
            if entity not in cfg.rules:
                continue
            regex = jre(C.FAST_FORMS.get(entity, C.ENTITY_PATTERNS[entity]))
            gate = None
            if literal := C.REQUIRED_LITERAL.get(entity):
                gate = lambda x, literal=literal: F.coalesce(x["t"].contains(literal), F.lit(False))
            elif len(numbers) > 1:
                gate = lambda x: F.col("__lw_numbers") | x["changed"]
            add(pattern(regex, _rule(cfg.rules[entity], key), entity, gate))

    if C.PERSON in cfg.rules:
        rule = _rule(cfg.rules[C.PERSON], key)
        if head:
            add(pattern(json_name_pattern(), rule, C.PERSON, before="$1", match="$2"))
        if persons_col is not None and tail:
            names = F.coalesce(F.col(persons_col), F.array().cast("array<string>"))
            add(lambda x: F.when(F.size(names) > 0, _hit(x, _persons_rewrite(x["t"], names, rule), F.lit(C.PERSON))).otherwise(x))

    if tail:
        usable = [(p, needed_literal(p.regex)) for p in cfg.patterns if usable_pattern(p.regex, substitutes=True)]
        for has_literal, run in groupby(usable, lambda u: u[1] is not None):
            if has_literal:
                run = list(run)
                cur = cur.withColumn(st, _fold_patterns(F.col(st), run, key))
            else:
                for p, _ in run:
                    add(pattern(jre(p.regex), _rule(p.rule, key), p.name))

    cur = cur.withColumn(detected_col, F.array_distinct(F.col(st)["d"])).withColumn(out_col, F.col(st)["t"])
    return cur.drop(st, "__lw_numbers")


def redact_names(
    df: DataFrame,
    names: DataFrame,
    key_cols: list[str],
    text_col: str = "text",
    cfg: C.RedactionConfig | None = None,
    *,
    name_col: str = "name",
    detected_col: str = "detected",
) -> DataFrame:
    """All layers with person names of a name table, found on the text as the JSON-name layer left it."""
    first = redact(df, text_col, cfg, detected_col=detected_col, part="before_names")
    named = person_names(first, names, key_cols, text_col, name_col, "__lw_persons")
    return redact(named, text_col, cfg, detected_col=detected_col, persons_col="__lw_persons", part="from_names").drop("__lw_persons")


def redact_text(
    df: DataFrame,
    text_col: str,
    cfg: C.RedactionConfig | None = None,
    *,
    persons_col: str | None = None,
) -> DataFrame:
    """Redact in place and keep the raw text as ``original_<col>`` plus the joined entity string."""
    out = redact(
        df.withColumn(f"original_{text_col}", F.col(text_col)), text_col, cfg, persons_col=persons_col
    )
    return out.withColumn("redacted_entities", F.array_join("detected", ", "))


def redaction_stats(df: DataFrame, by: list[str] | str | None = "source", text_col: str = "msg", detected_col: str = "detected") -> DataFrame:
    """Lines counted (non-empty text) and lines with at least one redaction, per group."""
    keys = [by] if isinstance(by, str) else list(by or [])
    counted = F.coalesce(F.length(F.col(text_col)) > 0, F.lit(False))
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(
        F.count_if(counted).alias("total_lines"),
        F.count_if(counted & (F.size(detected_col) > 0)).alias("redacted_lines"),
    )


def entity_counts(df: DataFrame, by: list[str] | str | None = "source", detected_col: str = "detected") -> DataFrame:
    """Lines per entity (a line counts once per entity), per group, long form."""
    keys = [by] if isinstance(by, str) else list(by or [])
    return (
        # the plain explode implies a filter, which is pushed below the redaction and runs it twice
        df.select(*keys, F.explode_outer(detected_col).alias("entity"))
        .where(F.col("entity").isNotNull())
        .groupBy(*keys, "entity")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


def source_summary(
    df: DataFrame,
    by: str = "source",
    order_col: str | None = None,
    text_col: str = "msg",
    detected_col: str = "detected",
) -> DataFrame:
    """Per source: lines counted, lines redacted and ``label×n`` entity hits.

    Hits are listed in order of first appearance (by ``order_col``, then the
    layer order inside a line); without ``order_col`` by entity name. Entities
    without a display label show their own name. One pass over the rows: each
    line becomes one row per entity (one row if none), counted per
    (source, entity), then rolled up per source.
    """
    order = F.col(order_col) if order_col else F.lit(0)
    counted = F.coalesce(F.length(F.col(text_col)) > 0, F.lit(False))
    rows = df.select(
        by, order.alias("__lw_o"), counted.alias("__lw_c"), (F.size(detected_col) > 0).alias("__lw_r"),
        F.posexplode_outer(detected_col).alias("__lw_p", "entity"),
    )
    line_row = F.coalesce(F.col("__lw_p"), F.lit(0)) == 0  # one row per line
    per = rows.groupBy(by, "entity").agg(
        F.count_if(line_row & F.col("__lw_c")).alias("__lw_lines"),
        F.count_if(line_row & F.col("__lw_c") & F.col("__lw_r")).alias("__lw_red"),
        F.count("entity").alias("n"),
        F.min(F.struct("__lw_o", "__lw_p")).alias("first"),
    )
    labels = F.create_map(*[x for k, v in C.ENTITY_DISPLAY.items() for x in (F.lit(k), F.lit(v))])
    item = F.concat(F.coalesce(F.element_at(labels, F.col("entity")), F.col("entity")), F.lit("×"), F.col("n").cast("string"))
    key = F.struct("first", "entity") if order_col else F.struct("entity")
    hits = F.sort_array(F.collect_list(F.when(F.col("entity").isNotNull(), F.struct(key.alias("k"), item.alias("v")))))
    return per.groupBy(by).agg(
        F.sum("__lw_lines").alias("total_lines"),
        F.sum("__lw_red").alias("redacted_lines"),
        F.array_join(F.transform(hits, lambda x: x["v"]), C.ENTITY_HIT_SEP).alias("entity_hits"),
    ).select(
        by, "total_lines", "redacted_lines",
        F.when(F.col("entity_hits") == "", F.lit(C.NO_HITS)).otherwise(F.col("entity_hits")).alias("entity_hits"),
    )

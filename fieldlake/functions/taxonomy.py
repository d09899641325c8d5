"""Taxonomy look-ups as Column expressions.

The vocabularies are small fixed tables, so they travel inside the plan as array or
map literals: no join, no shuffle and no copy of the text per vocabulary row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlake.functions import text as T
from fieldlake.functions import vocab


def _is_devanagari(s: str) -> bool:
    return any("\u0900" <= ch <= "\u097f" for ch in s)


def _sql(v) -> str:
    if isinstance(v, list):
        return f"array({', '.join(_sql(x) for x in v)})" if v else "cast(array() AS array<string>)"
    if v is None:
        return "cast(null AS string)"
    if isinstance(v, (int, float)):
        return f"{v!r}D" if isinstance(v, float) else repr(v)
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _literal(rows: list[dict]) -> Column:
    """An array of structs; the optimizer folds the whole expression into one literal."""
    structs = ("named_struct(" + ", ".join(f"'{k}', {_sql(v)}" for k, v in r.items()) + ")" for r in rows)
    return F.expr(f"array({', '.join(structs)})")


def _map(pairs: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in pairs.items()) + ")")


def bind(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body`.

    An expression used inside a lambda is otherwise evaluated once per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _by_script(text: Column, build) -> Column:
    """`build(text, keep)` without the Devanagari vocabulary where the text has none."""

    def choose(bound):
        full = build(bound, lambda s: True)
        latin = build(bound, lambda s: not _is_devanagari(s))
        return F.when(bound.rlike(T.DEVANAGARI), full).otherwise(latin)

    return bind(text, choose)


def resolve_crop(c: Column) -> Column:
    """Canonical crop: exact alias, else the longest alias (>= 3 characters) contained."""
    key = F.lower(T.strip(c))
    rows = vocab.crop_alias_rows()
    by_length = sorted((r for r in rows if len(r[0]) >= 3), key=lambda r: -len(r[0]))

    def build(low, keep):
        table = _literal([{"alias": a, "name": n} for a, n, _ in by_length if keep(a)])
        return F.get(F.filter(table, lambda r: F.contains(low, r["alias"])), F.lit(0))["name"]

    exact = F.try_element_at(_map({a: n for a, n, _ in rows}), key)
    return F.coalesce(exact, _by_script(key, build))


def extract_crops(c: Column) -> Column:
    """All crops in a text, ordered by where the longest matching alias of each starts."""
    rows = [r for r in vocab.crop_alias_rows() if len(r[0]) >= 2]
    ranked = sorted(rows, key=lambda r: -len(r[0]))
    by_crop: dict[str, list[dict]] = {}
    for rank, (alias, name, _) in enumerate(ranked):
        by_crop.setdefault(name, []).append({"alias": alias, "rank": rank})

    def build(low, keep):
        table = _literal([
            {"name": n, "aliases": [a["alias"] for a in al if keep(a["alias"])],
             "ranks": [a["rank"] for a in al if keep(a["alias"])]}
            for n, al in by_crop.items()
        ])

        def first_hit(crop):
            hit = F.get(F.filter(crop["aliases"], lambda a: F.contains(low, a)), F.lit(0))
            rank = F.element_at(crop["ranks"], F.array_position(crop["aliases"], hit).cast("int"))
            return F.when(
                hit.isNotNull(),
                F.struct(F.instr(low, hit).alias("pos"), rank.alias("rank"), crop["name"].alias("name")),
            )

        hits = F.filter(F.transform(table, first_hit), lambda h: h.isNotNull())
        return F.transform(F.array_sort(hits), lambda h: h["name"])

    return F.coalesce(_by_script(F.lower(c), build), F.array().cast("array<string>"))


def _keyword_hits(c: Column, table: dict[str, list[str]]) -> Column:
    def build(low, keep):
        rows = _literal([
            {"name": n, "words": [w.lower() for w in ws if keep(w)]} for n, ws in table.items()
        ])
        hit = F.filter(rows, lambda r: F.exists(r["words"], lambda w: F.contains(low, w)))
        return F.transform(hit, lambda r: r["name"])

    hits = _by_script(F.lower(F.coalesce(c, F.lit(""))), build)
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("general")))


def detect_categories(c: Column) -> Column:
    return _keyword_hits(c, vocab.CATEGORY_KEYWORDS)


def detect_intents(c: Column) -> Column:
    return _keyword_hits(c, vocab.intent_keywords())


def resolve_district(c: Column) -> Column:
    """Struct(state_id, state, district, zone): exact alias, else the first alias where
    either string contains the other."""
    table = _literal([
        {"alias": a, "state_id": sid, "state": st, "district": d, "zone": z}
        for a, sid, st, d, z, _ in vocab.district_rows()
    ])

    def lookup(key):
        exact = F.get(F.filter(table, lambda r: r["alias"] == key), F.lit(0))
        near = F.filter(table, lambda r: F.contains(key, r["alias"]) | F.contains(r["alias"], key))
        return F.coalesce(exact, F.get(near, F.lit(0)))

    found = F.when(F.coalesce(c, F.lit("")) != "", bind(F.lower(T.strip(c)), lookup))
    return F.when(
        found.isNotNull(),
        F.struct(*[found[f].alias(f) for f in ("state_id", "state", "district", "zone")]),
    )


def standard_region(district: Column, state: Column) -> Column:
    """Resolved region, or a fallback row that keeps the given district and state."""
    hit = resolve_district(district)
    low = F.lower(F.coalesce(state, F.lit("")))
    fallback = F.struct(
        F.when(low.startswith("maha"), "MH").alias("state_id"),
        F.when(low != "", state).otherwise("Maharashtra").alias("state"),
        district.alias("district"),
        F.lit(None).cast("string").alias("zone"),
    )
    return F.coalesce(hit, fallback)


def normalize_unit(c: Column) -> Column:
    """Unit token -> canonical unit; degree signs are ignored, the first dimension wins."""
    first: dict[str, str] = {}
    for _, alias, _, name, _ in vocab.unit_rows():
        first.setdefault(alias.lower().replace("°", ""), name)
    key = F.replace(F.lower(T.strip(F.coalesce(c, F.lit("")))), F.lit("°"), F.lit(""))
    return F.try_element_at(_map(first), key)


def _convert(value: Column, unit_from: Column, unit_to: Column, dimension: str) -> Column:
    factors = _map({a: f for d, a, f, _, _ in vocab.unit_rows() if d == dimension})
    return (
        value * F.try_element_at(factors, F.lower(unit_from)) / F.try_element_at(factors, F.lower(unit_to))
    )


def convert_mass(value: Column, unit_from: Column, unit_to: Column) -> Column:
    """Mass in another unit; null when either unit is unknown."""
    return _convert(value, unit_from, unit_to, "mass")


def convert_area(value: Column, unit_from: Column, unit_to: Column) -> Column:
    return _convert(value, unit_from, unit_to, "area")


def record_category(list_key: Column, domain: Column) -> Column:
    """Category of a record: the list key decides, then the lake domain, then general."""
    return F.coalesce(
        F.try_element_at(_map(vocab.LIST_KEY_CATEGORY), list_key),
        F.try_element_at(_map(vocab.DOMAIN_CATEGORY), domain),
        F.lit("general"),
    )


def label_category(label: Column) -> Column:
    return F.try_element_at(_map(vocab.NODE_LABEL_CATEGORY), F.lower(label))

"""Scalar functions as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelcover.functions import dims


def literal_map(values: dict) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))


def lookup(values: dict, key: Column) -> Column:
    """values[key], null if absent or null."""
    return F.try_element_at(literal_map(values), key)


def slugify(text: Column) -> Column:
    t = F.lower(text)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def to_fixed_1(x: Column) -> Column:
    """One decimal, ties of the exact double upwards; only x with 4 * x odd can tie."""
    tie = F.abs(F.pmod(x * 4, F.lit(2.0)) - 1) < F.lit(1e-12)
    return F.replace(F.call_function("format_number", F.when(tie, x + 0.01).otherwise(x), F.lit("0.0")), F.lit(","), F.lit(""))


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def half_up(x: Column) -> Column:
    """The nearest whole number, halves upwards."""
    return F.floor(x + 0.5).cast("long")


def num(x: Column) -> Column:
    """The leading number of a text, else 0."""
    found = F.regexp_extract(F.trim(x.cast("string")), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("double"), F.lit(0.0))


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, half_up(part / whole * 100)).otherwise(0).cast("long")


def pct_label(part: Column, whole: Column) -> Column:
    share = F.try_divide(part, whole) * 100
    return F.when(~(part > 0) | part.isNull(), "0 %").when(share < 0.5, "< 1 %").otherwise(F.concat(half_up(share).cast("string"), F.lit(" %")))


def fmt_ha(m2: Column) -> Column:
    """Hectares with 0, 1 or 2 decimals by size, no digit grouping."""
    h = m2 / 1e4
    digits = F.when(h >= 100, half_up(h).cast("double")).when(h >= 1, half_up(h * 10) / 10).otherwise(half_up(h * 100) / 100)
    return F.when((h > 0) & (h < 0.01), "< 0.01").otherwise(F.regexp_replace(digits.cast("string"), r"\.0$", ""))


def parse_area(text: Column) -> Column:
    """A number with spaces, apostrophes or commas between digits; null if it is none."""
    return F.nullif(F.regexp_replace(text, r"[\s',]", ""), F.lit("")).try_cast("double")


def format_area(x: Column) -> Column:
    """Four decimals, closing zeros cut; null becomes empty."""
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x), r"0+$", ""), r"\.$", "")
    return F.when(x.isNull(), "").otherwise(shown)


def typoch_code(label: Column) -> Column:
    return F.regexp_extract(F.coalesce(label, F.lit("")), r"^\s*(\S*)", 1)


def _parts(label: Column) -> Column:
    return F.filter(F.split(typoch_code(label), r"\."), lambda p: p != "")


def code_at_level(label: Column, n: int) -> Column:
    return F.when(F.size(_parts(label)) < n, "").otherwise(F.array_join(F.slice(_parts(label), 1, n), "."))


def label_at_level(label: Column, n: int, names: dict[str, str]) -> Column:
    """"code name" at a level; the raw label if its own level has no name, else the bare code."""
    code = code_at_level(label, n)
    name = lookup(names, code)
    raw = F.trim(F.coalesce(label, F.lit("")))
    return F.when(code == "", "").when(name.isNotNull(), F.concat_ws(" ", code, name)).otherwise(F.when(F.size(_parts(label)) == n, raw).otherwise(code))


def finest(label: Column, values: dict) -> Column:
    """The value of the longest leading part of the code that values has."""
    return F.coalesce(*[lookup(values, code_at_level(label, n)) for n in (4, 3, 2, 1)])


def typoch_to_art(label: Column) -> Column:
    return finest(label, dims.HABITAT_TO_ART)


def classify_habitat(label: Column) -> dict[str, Column]:
    """greenspace, vbs_kat, vbs_produktiv, vbs_typ by the finest code, else neutral."""
    table = {k: v[1:] for k, v in dims.HABITAT_L1.items()} | dims.HABITAT_FINER
    code = F.coalesce(*[F.when(F.array_contains(F.array(*map(F.lit, table)), code_at_level(label, n)), code_at_level(label, n)) for n in (2, 1)])
    out = {}
    for i, (name, default) in enumerate((("greenspace", dims.NOT_GREEN), ("vbs_kat", "kat_d"), ("vbs_produktiv", "unproduktiv"), ("vbs_typ", None))):
        values = {k: v[i] for k, v in table.items() if v[i] is not None}
        found = lookup(values, code)
        out[name] = found if default is None else F.coalesce(found, F.lit(default))
    return out


def area_key(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), slugify(text), F.lit("_m2"))


def area_key_slug(prefix: str, key: Column) -> Column:
    """What area_key was made of; null if it is another column."""
    return F.nullif(F.regexp_extract(key, f"^{prefix}_(.+)_m2$", 1), F.lit(""))


def hab_code(slug: Column) -> Column:
    return F.replace(F.regexp_extract(slug, r"^(\d+(?:_\d+)*)(?:_|$)", 1), F.lit("_"), F.lit("."))


def hab_digit(slug: Column) -> Column:
    legacy = {"gewaesser": "1", "ufer_feuchtgebiete": "2", "gletscher_fels_schutt_geroell": "3", "gruenland": "4", "krautsaeume_hochstauden_gebuesche": "5", "waelder": "6", "pionier_ruderalvegetation": "7", "pflanzungen_aecker_kulturen": "8", "gebaeude_anlagen": "9"}
    return F.when(slug.rlike("^[1-9]"), F.substring(slug, 1, 1)).otherwise(F.coalesce(lookup(legacy, slug), F.lit("")))


def code_label(code: Column, labels: dict[str, str]) -> Column:
    """Label of a code, of the code without leading zeros, else the code; blank becomes a dash."""
    text = F.coalesce(code, F.lit(""))
    return F.when(text == "", "—").otherwise(F.coalesce(lookup(labels, text), lookup(labels, F.regexp_replace(text, "^0+", "")), text))


def delta_text(diff: Column, base: Column) -> Column:
    """"+50 (+5 %)": rounded difference and, where base is above 0, its share with one decimal."""
    d = half_up(diff)
    p = half_up(F.try_divide(diff, base) * 1000) / 10
    shown = F.regexp_replace(p.cast("string"), r"\.0$", "")
    return F.concat(F.when(d > 0, "+").otherwise(""), d.cast("string"), F.when(base > 0, F.concat(F.lit(" ("), F.when(p > 0, "+").otherwise(""), shown, F.lit(" %)"))).otherwise(""))


def norm_number(value: Column) -> Column:
    """A whole number with a decimal point or exponent as an integer's text, else the value's text as it is."""
    text = value.cast("string")
    number = text.try_cast("double")
    whole = text.rlike(r"^-?\d+\.\d+(E\d+)?$") & (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("long").cast("string")).otherwise(text)


def close(a: Column, b: Column, rtol: float = 1e-4, atol: float = 0.02) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.greatest(F.abs(a), F.abs(b))

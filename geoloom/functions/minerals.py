"""Classifications of spring water, written as one compound word, to types.

A value counts only if every part of it is understood: half a classification
looks like a whole one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The types in their canonical order.
TYPES = ("simple", "chloride", "bicarbonate", "sulfate", "carbon-dioxide", "iron", "acidic", "iodine", "sulfur", "radioactive", "aluminium")
#: Fixed values: (word, the type it names), in the order in which it is looked for.
TOKENS = (
    ("Fe(III)", "iron"),
    ("Fe(II)", "iron"),
    ("鉄(III)", "iron"),
    ("鉄(II)", "iron"),
    ("炭酸水素塩", "bicarbonate"),
    ("炭酸水素", "bicarbonate"),
    ("重炭酸", "bicarbonate"),
    ("重曹", "bicarbonate"),
    ("HCO3", "bicarbonate"),
    ("硫酸塩", "sulfate"),
    ("硫酸", "sulfate"),
    ("SO4", "sulfate"),
    ("芒硝", "sulfate"),
    ("石膏", "sulfate"),
    ("正苦味", "sulfate"),
    ("硫化水素", "sulfur"),
    ("硫黄", "sulfur"),
    ("H2S", "sulfur"),
    ("含S", "sulfur"),
    ("塩化物", "chloride"),
    ("塩化", "chloride"),
    ("食塩", "chloride"),
    ("Cl", "chloride"),
    ("二酸化炭素", "carbon-dioxide"),
    ("炭酸", "carbon-dioxide"),
    ("CO2", "carbon-dioxide"),
    ("放射能", "radioactive"),
    ("ラドン", "radioactive"),
    ("ラジウム", "radioactive"),
    ("Rn", "radioactive"),
    ("緑礬", "iron"),
    ("鉄", "iron"),
    ("Fe", "iron"),
    ("酸性", "acidic"),
    ("ヨウ素", "iodine"),
    ("沃素", "iodine"),
    ("I", "iodine"),
    ("アルミニウム", "aluminium"),
    ("明礬", "aluminium"),
    ("単純", "simple"),
)
#: Words that name no type, in the order in which they are taken out.
NOISE = (
    "温泉",
    "冷鉱泉",
    "冷泉",
    "鉱泉",
    "泉",
    "ナトリウム",
    "カルシウム",
    "マグネシウム",
    "カリウム",
    "アンモニウム",
    "Na",
    "Ca",
    "Mg",
    "NH4",
    "K",
    "アルカリ性",
    "弱アルカリ性",
    "弱酸性",
    "中性",
    "低張性",
    "等張性",
    "高張性",
    "高温",
    "低温",
    "含有",
    "含",
    "弱",
    "強",
    "微",
    "性",
    "塩類",
    "土類",
    "塩",
    "類",
    "・",
    "-",
    "−",
    "‐",
    "―",
    "(",
    ")",
    "（",
    "）",
    "、",
    ",",
)
BLANKS = r"[\s 　]"


def canonical_types(found: Column) -> Column:
    """Each type once, in order; simple only where nothing else is found."""
    others = F.size(F.array_distinct(found)) > 1
    return F.filter(F.array(*map(F.lit, TYPES)), lambda t: F.array_contains(found, t) & ~((t == "simple") & others))


def read_classification(value: Column) -> Column:
    """struct<types, residue>; the residue is what no word explains."""
    whole = F.coalesce(F.regexp_replace(value, f"^{BLANKS}+|{BLANKS}+$", ""), F.lit(""))
    start = F.struct(F.when(whole == "N/A", "").otherwise(whole).alias("rest"), F.array().cast("array<string>").alias("types"))
    tokens = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(kind).alias("type")) for t, kind in TOKENS])

    def take(state: Column, t: Column) -> Column:
        more = F.when(F.contains(state["rest"], t["token"]), F.array_append(state["types"], t["type"])).otherwise(state["types"])
        return F.struct(F.replace(state["rest"], t["token"], F.lit("")).alias("rest"), more.alias("types"))

    def finish(state: Column) -> Column:
        rest = F.aggregate(F.array(*map(F.lit, NOISE)), state["rest"], lambda r, w: F.replace(r, w, F.lit("")))
        return F.struct(canonical_types(state["types"]).alias("types"), F.translate(rest, " 　", "").alias("residue"))

    return F.aggregate(tokens, start, take, finish)


def mineral_types(value: Column) -> Column:
    """The types, or null where a part of the value is not understood."""
    read = read_classification(value)
    return F.when(read["residue"] == "", read["types"])


def classification_outcome(values: Column, upstream: Column, claim: Column) -> Column:
    """struct<write, contest, withheld> for one spring.

    ``values``: the distinct classifications of its wells; ``upstream``: types
    it has already; ``claim``: types somebody claims, or null.  A claim wins,
    but a fully understood value that says otherwise is a contest.
    """
    nothing = F.lit(None).cast("array<string>")
    open_field = (F.size(values) == 1) & (F.coalesce(F.size(upstream), F.lit(0)) <= 0)

    def verdict(read: Column) -> Column:
        types, whole = read["types"], read["residue"] == ""
        told = open_field & whole & (F.size(types) > 0)
        quoted = F.regexp_replace(read["residue"], r'(["\\])', r"\\$1")
        withheld = F.when(F.size(values) > 1, "wells disagree on 泉質").when(
            open_field & claim.isNull() & ~whole, F.concat(F.lit('泉質 not fully understood: "'), quoted, F.lit('"'))
        )
        return F.struct(
            F.when(told & claim.isNull(), types).otherwise(nothing).alias("write"),
            F.when(told & claim.isNotNull() & (types != canonical_types(claim)), types).otherwise(nothing).alias("contest"),
            withheld.alias("withheld"),
        )

    # a lambda's variable is worked out once; a column would be read again wherever it is named
    return F.get(F.transform(F.array(F.when(open_field, read_classification(F.get(values, F.lit(0))))), verdict), F.lit(0))

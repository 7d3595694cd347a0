"""Reference designators, misreads and text formats as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Designator prefixes found anywhere in a text, in matching order.
REFDES_PREFIXES = ["IC", "R", "C", "L", "Q", "D", "FI", "EP", "BPF", "F", "J", "TR", "SW", "X",
                   "Y", "CR", "RB", "RV", "U", "VR", "Z"]
# Designator prefixes accepted at the start of a text.
HEAD_PREFIXES = ["IC", "Q", "F", "FI", "D", "J", "C", "R", "L", "X", "U", "TR", "Z"]
# Component type by prefix pattern; the first match wins.
TYPE_RULES = [("IC", "IC"), ("Q", "transistor"), ("R", "resistor"), ("C", "capacitor"),
              ("L", "inductor"), ("D", "diode"), ("X", "xtal"), ("FI?", "filter"),
              ("J", "connector"), ("EP", "pad"), ("[VF]L", "filter"), ("W", "jumper"),
              ("B", "ferrite"), ("T", "transformer"), ("V", "varactor")]
# Symbol drawn for a prefix.
SYMBOL_RULES = [("circle", ["Q", "TR"]), ("ic", ["IC", "U", "FI", "F", "X"]),
                ("cap", ["C"]), ("ind", ["L"]), ("res", ["R"])]
# Shape that association prefers for a prefix.
EXPECTED_SHAPE = {"Q": "circle", "TR": "circle", "C": "cap", "IC": "ic", "U": "ic",
                  "FI": "ic", "F": "ic", "L": "circle", "R": "cap"}
# Characters that readers confuse.
MISREADS = [("1", "I"), ("0", "O"), ("5", "S"), ("B", "8"), ("Q", "O")]
# Fixed value: a part name that stands for any designator.
WILDCARD_PART = "FL-363"
# Part-number formats.
MODEL_PATTERNS = [r"^[A-Z]{1,4}\d[\w\-]{2,}$", r"^[A-Z]{1,4}-\d{2,}$"]

_ANYWHERE = r"(?iU)\b(" + "|".join(REFDES_PREFIXES) + r")\s*(\d{1,4})\b"
_HEAD = r"(?iU)^(" + "|".join(HEAD_PREFIXES) + r")\s*\d+"
# Fixed value: how chain elements name parts.
_CHAIN_TOKEN = r"[A-Z]{1,3}[0-9]{1,4}[A-Z]?"


def refdes_all(text: Column) -> Column:
    """Every designator in a text as an array of ``PREFIXnumber``."""
    found = F.regexp_extract_all(text, F.lit(_ANYWHERE), F.lit(0))
    return F.transform(found, lambda m: F.upper(F.regexp_replace(m, r"(?U)\s+", "")))


def refdes_head(text: Column) -> Column:
    """The text without spaces, upper case, if it starts like a designator."""
    clean = F.trim(text)
    return F.when(clean.rlike(_HEAD), F.upper(F.replace(clean, F.lit(" "), F.lit(""))))


def chain_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_CHAIN_TOKEN), F.lit(0))


def letters(ref: Column) -> Column:
    return F.upper(F.regexp_replace(ref, r"[^\p{L}]", ""))


def component_type(ref: Column) -> Column:
    first, rest = TYPE_RULES[0], TYPE_RULES[1:]
    ladder = F.when(ref.rlike("^" + first[0]), first[1])
    for pattern, name in rest:
        ladder = ladder.when(ref.rlike("^" + pattern), name)
    return ladder.otherwise("other")


def symbol_type(ref: Column) -> Column:
    prefix = letters(ref)
    (name, prefixes), rest = SYMBOL_RULES[0], SYMBOL_RULES[1:]
    ladder = F.when(prefix.isin(prefixes), name)
    for name, prefixes in rest:
        ladder = ladder.when(prefix.isin(prefixes), name)
    return ladder.otherwise("cap")


def expected_shape(ref: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in EXPECTED_SHAPE.items() for v in pair])
    return F.try_element_at(table, letters(ref))


def norm_key(key: Column) -> Column:
    return F.upper(F.split(key, "_")[0])


def norm_misread(text: Column) -> Column:
    """Letters that look like a one become a one; lossy on purpose."""
    return F.translate(text, "IL", "11")


def misread_variants(text: Column) -> Column:
    """Texts that differ by one kind of confused character, in table order."""
    pairs = [p for a, b in MISREADS for p in ((a, b), (b, a))]
    variants = F.array(*[F.replace(text, F.lit(a), F.lit(b)) for a, b in pairs])
    return F.filter(F.array_distinct(variants), lambda v: v != text)


def ref_reads(target: Column, text: Column) -> Column:
    """Whether a text read at a symbol confirms its designator."""
    wanted = norm_misread(target)
    read = norm_misread(F.upper(F.replace(F.trim(text), F.lit(" "), F.lit(""))))
    match = (read != "") & (F.contains(wanted, read) | F.contains(read, wanted))
    return F.coalesce(match | F.contains(text, F.lit(WILDCARD_PART)), F.lit(False))


def text_matches(ref: Column, texts: Column, fuzzy: bool = False) -> Column:
    if not fuzzy:
        return F.exists(texts, lambda t: t == ref)
    return F.exists(texts, lambda t: F.contains(t, ref) | F.contains(ref, t)
                    | F.startswith(t, F.substring(ref, 1, 2)))


def text_verdict(ref: Column, texts: Column, fuzzy: bool = False) -> Column:
    return (F.when(text_matches(ref, texts, fuzzy), "match")
            .when(F.size(texts) == 0, "not_found").otherwise("mismatch"))


def model_text(text: Column) -> Column:
    """Upper-case part number, null if the text is none."""
    clean = F.upper(F.trim(text))
    return F.when(reduce(lambda a, b: a | b, [clean.rlike(p) for p in MODEL_PATTERNS]), clean)


def plausible_refdes(text: Column) -> Column:
    clean = F.trim(text)
    return (F.length(clean) > 0) & (F.length(clean) <= 6) & ~clean.rlike(r"^\d+$")


def dpi_from_name(name: Column, default: int = 600) -> Column:
    token = F.regexp_extract(name, r"(\d{2,4})\s*dpi", 1)
    return F.when(token == "", default).otherwise(token.cast("int"))


def crop_name(idx: Column, category: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.format_string("r%04d_%s_%dx%d_w%dh%d.png", idx, category, cx, cy, w, h)


def parse_coord_list(text: Column) -> Column:
    """``(x,y)=REF`` items as an array of structs ``refdes, x, y``."""
    items = F.regexp_extract_all(text, F.lit(r"\(\d+,\d+\)\s*=\s*\w+"), F.lit(0))
    return F.transform(items, lambda i: F.struct(
        F.regexp_extract(i, r"=\s*(\w+)", 1).alias("refdes"),
        F.regexp_extract(i, r"\((\d+),", 1).cast("long").alias("x"),
        F.regexp_extract(i, r",(\d+)\)", 1).cast("long").alias("y")))


# Wording of a detection class in descriptions.
CLASS_TEXT = {"board": "PCB 大板", "ic": "IC 封装", "resistor": "电阻", "capacitor": "电容",
              "inductor": "电感", "medium_passive": "中型无源器件", "small_passive": "小型无源器件",
              "tiny_passive": "微型无源器件", "trace_segment": "走线段",
              "large_passive": "大型无源器件", "unknown": "未分类"}
NEARBY_TEXT = " — 附近有: "


def describe(category: Column, nearby: Column) -> Column:
    """Class wording and up to three designators nearby."""
    table = F.create_map(*[F.lit(v) for pair in CLASS_TEXT.items() for v in pair])
    wording = F.coalesce(F.try_element_at(table, category), category)
    near = F.concat_ws(", ", F.slice(F.coalesce(nearby, F.array().cast("array<string>")), 1, 3))
    return F.when(near == "", wording).otherwise(F.concat(wording, F.lit(NEARBY_TEXT), near))

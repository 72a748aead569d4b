"""Tokens, text statistics and name sanitisers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token alternatives, tried left to right: abbreviations with slashes, letters, digits, symbol runs. (?U) makes \s Unicode white space.
TOKEN = r"(?U)[A-Za-z0-9]+(?:/[A-Za-z0-9]+)+|[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]+"
#: Words whose full stop ends no sentence; fixed values.
ABBREVIATIONS = ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "St."]


def tokens(text: Column) -> Column:
    """Token strings in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_type(token: Column) -> Column:
    return F.when(token.rlike("^[0-9]+$"), "NUMBER").when(token.rlike("^[A-Za-z0-9]+(/[A-Za-z0-9]+)+$"), "ACRONYM").when(token.rlike("^[A-Za-z]+$"), "WORD").otherwise("PUNCTUATION")


def token_counts(text: Column) -> dict[str, Column]:
    """Tokens of each type, counted without building them. An abbreviation takes the whole run of letters and digits that it begins in, so what is left of the text holds the other tokens unchanged."""
    abbreviation = "[A-Za-z0-9]+(?:/[A-Za-z0-9]+)+"
    rest = F.when(F.contains(text, F.lit("/")), F.regexp_replace(text, abbreviation, " ")).otherwise(text)
    count = lambda where, pattern: F.regexp_count(where, F.lit(pattern)).cast("long")
    return {
        "ACRONYM": F.when(F.contains(text, F.lit("/")), count(text, abbreviation)).otherwise(F.lit(0).cast("long")),
        "NUMBER": count(rest, "[0-9]+"),
        "WORD": count(rest, "[A-Za-z]+"),
        "PUNCTUATION": count(rest, r"(?U)[^A-Za-z0-9\s]+"),
    }


def tokens_after_newline(text: Column) -> Column:
    """Tokens with a line break in the white space before them, the first not counted. Every gap between tokens that holds a break matches once, from the first break on, so no token is built."""
    within = F.regexp_extract(text, r"(?Us)\A\s*+(.*\S)", 1)
    return F.regexp_count(within, F.lit(r"(?U)[\n\r]\s*+")).cast("long")


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def sentence_end(token: Column, type_: Column, before: Column, gap_after: Column, next_token: Column) -> Column:
    """Whether a sentence ends after a token: punctuation that ends in .?! and does not close an abbreviation, or a line break before a capital."""
    stop = (type_ == "PUNCTUATION") & token.rlike("[.?!]$") & ~F.concat(F.coalesce(before, F.lit("")), token).isin(ABBREVIATIONS)
    line = F.contains(F.coalesce(gap_after, F.lit("")), F.lit("\n")) & is_upper(F.substring(F.coalesce(next_token, F.lit("")), 1, 1))
    return stop | line


def one_line(text: Column) -> Column:
    """Outer white space gone, inner runs one blank; null where nothing is left."""
    flat = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.nullif(flat, F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def statistics(text: Column) -> dict[str, Column]:
    """Characters, words, lines, lines with text, and characters a line."""
    lines = F.split(text, "\n", -1)
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return {
        "n_chars": F.length(text).cast("long"),
        "n_words": F.size(words).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_full_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(?U)\S"))).cast("long"),
        "chars_per_line": F.length(text) / F.size(lines),
    }


def property_name(name: Column) -> Column:
    """A storable property name: letters, digits, _ and CJK; never empty, never a leading digit. Null and '' stay."""
    s = F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9_一-鿿]", "_"), "_+", "_")
    s = F.regexp_replace(s, "^_|_$", "")
    s = F.when(s == "", "property").when(s.rlike(r"^\p{Nd}"), F.concat(F.lit("prop_"), s)).otherwise(s)
    return F.when(name == "", name).otherwise(s)


def match_name(name: Column) -> Column:
    """A name for matching: as property_name, but CJK punctuation stays and nothing stands for an empty result."""
    s = F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9_一-鿿（）《》“”、？！：；。，]", "_"), "_+", "_")
    s = F.regexp_replace(s, "^_|_$", "")
    return F.when(s.rlike(r"^\p{Nd}"), F.concat(F.lit("_"), s)).otherwise(s)


def relation_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}]", "_")


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"(?U)[\s.]+", "_")


def entity_name(name: Column, type_: Column) -> Column:
    """A name for comparison: no white space, quotes or brackets; no company or person suffix; lower case if ASCII."""
    s = F.regexp_replace(F.regexp_replace(name, r"(?U)\s+", ""), r"""["'《》【】\[\]()]""", "")
    s = F.when(type_.isin("公司", "Company"), F.regexp_replace(s, "(有限公司|股份有限公司|公司|集团)$", "")).when(type_.isin("人物", "Person"), F.regexp_replace(s, "(先生|女士|教授|博士)$", "")).otherwise(s)
    return F.when(s.rlike("^[A-Za-z0-9]+$"), F.lower(s)).otherwise(s)


def stem(token: Column) -> Column:
    """Lower case; a final s goes from tokens of over three letters that do not end in ss."""
    low = F.lower(token)
    return F.when((F.length(low) > 3) & low.rlike("[^s]s$"), F.regexp_replace(low, "s$", "")).otherwise(low)


def size_text(n: Column) -> Column:
    kb, mb = 1024, 1024 * 1024
    return F.when(n < kb, F.format_string("%d B", n.cast("long"))).when(n < mb, F.format_string("%.1f KB", F.bround(n / kb, 1))).otherwise(F.format_string("%.1f MB", F.bround(n / mb, 1)))


#: File kinds by extension; fixed values.
ROUTES = {
    "pdf": [".pdf"],
    "office": [".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx"],
    "image": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff"],
    "text": [".txt", ".md", ".csv", ".json", ".xml"],
}
#: Kind and description of an extension; fixed values.
EXTENSIONS = {
    ".pdf": ("document", "PDF文档"),
    ".doc": ("document", "Word文档"),
    ".docx": ("document", "Word文档"),
    ".xls": ("spreadsheet", "Excel表格"),
    ".xlsx": ("spreadsheet", "Excel表格"),
    ".ppt": ("presentation", "PowerPoint演示"),
    ".pptx": ("presentation", "PowerPoint演示"),
    ".jpg": ("image", "JPEG图片"),
    ".jpeg": ("image", "JPEG图片"),
    ".png": ("image", "PNG图片"),
    ".gif": ("image", "GIF图片"),
    ".txt": ("text", "文本文件"),
    ".md": ("text", "Markdown文件"),
    ".csv": ("data", "CSV数据文件"),
    ".json": ("data", "JSON数据文件"),
}
UNKNOWN_EXTENSION = ("unknown", "未知类型文件")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1))


def route(name: Column) -> Column:
    out = F.lit("unknown")
    for kind, exts in ROUTES.items():
        out = F.when(extension(name).isin(exts), kind).otherwise(out)
    return out


def extension_info(ext: Column) -> Column:
    """struct(type, description)."""
    low = F.lower(ext)
    pair = lambda t: F.struct(F.lit(t[0]).alias("type"), F.lit(t[1]).alias("description"))
    table = F.create_map(*[x for k, v in EXTENSIONS.items() for x in (F.lit(k), pair(v))])
    return F.coalesce(F.element_at(table, low), pair(UNKNOWN_EXTENSION))


def stem_of_file(name: Column) -> Column:
    """The part before the first dot."""
    return F.substring_index(name, ".", 1)


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def first_filled(props: Column, keys: list[str]) -> Column:
    """The first value that is neither missing nor empty."""
    return F.coalesce(*[F.nullif(props[k], F.lit("")) for k in keys])

"""What kind of file a payload is: by its declared name and type, else by its bytes; and texts as lines with hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File extensions and media types by kind, in the order in which kinds are tried. Fixed values.
EXTENSIONS = {
    "pdf": "pdf", "image": "png jpg jpeg gif bmp webp tif tiff", "docx": "docx", "spreadsheet": "csv tsv xls xlsx xlsb ods", "pptx": "pptx",
    "text_like": """txt md markdown json jsonl ndjson yaml yml xml svg log rst toml ini cfg conf env properties
        ts tsx js jsx mjs cjs css scss less sass vue svelte rs go c h cpp cc cxx hpp hh java kt kts scala groovy gradle cs fs vb csproj sln
        py rb php lua pl pm r jl swift dart m mm ex exs erl hs ml clj cljs elm sh bash zsh fish ps1 bat cmd tf hcl dockerfile vagrantfile
        sql graphql gql proto avsc makefile cmake ninja bazel buck html htm""",
}
MEDIA_TYPES = {
    "pdf": "application/pdf", "image": "image/png image/jpeg image/gif image/bmp image/webp image/tiff", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "spreadsheet": """text/csv application/csv text/tab-separated-values application/vnd.ms-excel application/vnd.openxmlformats-officedocument.spreadsheetml.sheet
        application/vnd.ms-excel.sheet.binary.macroenabled.12 application/vnd.oasis.opendocument.spreadsheet""",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "text_like": """application/json application/jsonl application/ndjson application/x-jsonlines application/x-ndjson application/yaml application/x-yaml application/toml
        application/xml text/xml image/svg+xml application/xhtml+xml""",
}
#: Media types that say nothing. Fixed values.
GENERIC = "application/octet-stream binary/octet-stream".split()


def declared_kind(name: Column, media_type: Column) -> Column:
    """The kind that a file's name or media type declares, the first that either does; null for neither."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1)
    extension = F.lower(F.trim(F.regexp_extract(base, r"^.+\.([^.]*)$", 1)))
    essence = media_essence(media_type)
    kind = F
    for k, extensions in EXTENSIONS.items():
        said = essence.isin(MEDIA_TYPES[k].split()) | (F.startswith(essence, F.lit("text/")) if k == "text_like" else F.lit(False))
        kind = kind.when(F.coalesce(said, F.lit(False)) | extension.isin(extensions.split()), F.lit(k))
    return kind


def media_essence(media_type: Column) -> Column:
    """A media type without parameters, in lower case; null for blank ones."""
    return F.nullif(F.trim(F.split_part(F.lower(F.trim(media_type)), F.lit(";"), F.lit(1))), F.lit(""))


def looks_binary(text: Column) -> Column:
    """A text with a zero character, or a fifth of whose characters are control characters other than line ends, tabs and form feeds."""
    control = F.regexp_count(text, F.lit(r"[\x{0001}-\x{0008}\x{000B}\x{000E}-\x{001F}\x{007F}-\x{009F}]"))
    return F.contains(text, F.lit("\0")) | ((F.length(text) > 0) & (5 * control >= F.length(text)))


def file_kind(name: Column, media_type: Column, content: Column) -> Column:
    """The declared kind; without one, text if the bytes are a text and no other type is declared, else binary."""
    valid = F.is_valid_utf8(content.cast("string"))
    other = F.coalesce(~media_essence(media_type).isin(GENERIC), F.lit(False))
    text = F.coalesce(valid & ~looks_binary(content.cast("string")), F.lit(False))
    return F.coalesce(declared_kind(name, media_type), F.when(~other & text, "text_like").otherwise("binary"))


def text_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, line, text, hint)``: lines of a text (a byte order mark goes, line ends are one sort) and what each looks like.

    Hints: code_fence, code_line (within fences), heading, table_row, list_item, endpoint, blank or paragraph.  A fold in the JVM over a text's lines.
    """
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "^\ufeff", ""), "\r\n?", "\n")
    fence = lambda x: x.rlike(r"^\s*(```|~~~)")
    # pieces that begin with a line that opens or closes a fence; the first one is before all of them, and every second one within
    def pieces(lines: Column) -> Column:
        fences = F.filter(F.transform(lines, lambda x, i: F.when(fence(x), i)), lambda i: i.isNotNull())
        both = F.arrays_zip(F.concat(F.array(F.lit(0)), fences).alias("start"), F.concat(fences, F.array(F.size(lines))).alias("end"))
        return F.transform(both, lambda x: F.struct(x["start"].alias("start"), F.slice(lines, x["start"] + 1, x["end"] - x["start"]).alias("lines")))

    # a text is cut once, before its lines become rows: what stands beside a generator is found for each of its rows
    cut = df.select(id_col, F.posexplode(F.element_at(F.transform(F.array(F.split(clean, "\n")), pieces), 1)).alias("_piece", "_p"))
    lines = cut.select(id_col, "_piece", F.col("_p.start").alias("_start"), F.col("_p.lines").alias("_lines"))
    lines = lines.select(id_col, "_piece", "_start", F.posexplode("_lines").alias("_at", "text")).withColumn("line", F.col("_start") + F.col("_at"))
    text = F.col("text")
    hint = (
        F.when(fence(text), "code_fence").when(F.col("_piece") % 2 == 1, "code_line").when(F.trim(text) == "", "blank").when(text.rlike(r"^#{1,6}\s+\S"), "heading")
        .when(text.rlike(r"^\s*\|.*\|.*\|\s*$"), "table_row").when(text.rlike(r"^\s*(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+/\S*"), "endpoint").when(text.rlike(r"^\s*(?:[-*+]|\d+[.)])\s+\S"), "list_item").otherwise("paragraph")
    )
    return lines.select(id_col, "line", "text", hint.alias("hint"))

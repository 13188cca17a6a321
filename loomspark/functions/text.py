"""Text expressions over columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_non_empty(*cols: Column) -> Column:
    """The first that is neither null nor the empty string, else the last."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def non_empty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order, with repeats."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", " "), " "), lambda x: x != "")


def keywords(question: Column) -> Column:
    """Acronyms, then numbers, of a question; the question itself if it has neither."""
    acronyms = F.regexp_extract_all(question, F.lit(r"\b[A-Z]{2,}\b"), F.lit(0))
    numbers = F.regexp_extract_all(question, F.lit(r"\$?[\d,]+\.?\d*%?"), F.lit(0))
    return first_non_empty(F.array_join(F.concat(acronyms, numbers), " "), question)


def verdict(answer: Column) -> Column:
    """A model's free text as YES, NEED_ADJACENT or NOT_FOUND."""
    a = F.upper(F.trim(F.coalesce(answer, F.lit(""))))
    return F.when(a.startswith("YES"), "YES").when(a.contains("ADJACENT") | a.startswith("NEED"), "NEED_ADJACENT").otherwise("NOT_FOUND")


def embed_text(chunk_type: Column, text: Column, text_nl: Column, breadcrumb: Column, title: Column) -> Column:
    """Headers for section and table title above the body that is embedded."""
    table = chunk_type == "table"
    body = F.when(table, first_non_empty(text_nl, text)).otherwise(text)
    bc, tt = F.trim(F.coalesce(breadcrumb, F.lit(""))), F.trim(F.coalesce(title, F.lit("")))
    head = F.concat_ws(
        "\n",
        F.when(bc != "", F.concat(F.lit("Section: "), bc)),
        F.when(table & (tt != "") & ~F.coalesce(non_empty(text_nl), F.lit(False)), F.concat(F.lit("Table: "), tt)),
    )
    return F.when(head == "", body).otherwise(F.concat(head, F.lit("\n\n"), body))


def lexical_text(chunk_type: Column, text: Column, text_nl: Column, breadcrumb: Column) -> Column:
    """What the keyword index holds: a table's prose, else the text under its breadcrumb."""
    plain = F.when(F.coalesce(non_empty(breadcrumb), F.lit(False)), F.concat(breadcrumb, F.lit("\n\n"), text)).otherwise(text)
    return F.coalesce(F.when(chunk_type == "table", first_non_empty(text_nl, text)).otherwise(plain), F.lit(""))


def query_text(question: Column, instruction: str = "Find passages of reports that answer the question.\nQuestion: ") -> Column:
    """A question as it is embedded: below an instruction."""
    return F.concat(F.lit(instruction), question)


def effective_page(page_number: Column, start_page: Column) -> Column:
    """The page of a chunk; 0 counts as absent."""
    return F.coalesce(F.nullif(page_number, F.lit(0)), F.nullif(start_page, F.lit(0)))


def id_prefix(chunk_id: Column) -> Column:
    """Part of an id before its first underscore; null if it has none or no number at its end."""
    return F.when(chunk_id.contains("_") & id_number(chunk_id).isNotNull(), F.split_part(chunk_id, F.lit("_"), F.lit(1)))


def id_number(chunk_id: Column) -> Column:
    """Number after the last underscore of an id, or null."""
    return F.when(chunk_id.contains("_"), F.split_part(chunk_id, F.lit("_"), F.lit(-1)).try_cast("int"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct tokens; null if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_normalise(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-9))
    return F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))


def two_way_softmax(yes: Column, no: Column) -> Column:
    return 1 / (1 + F.exp(no - yes))


def image_parts(image: Column) -> Column:
    """struct(mime, data) of a data URL, or of bare base64 taken as JPEG."""
    url = image.startswith("data:")
    mime = F.when(url, F.regexp_extract(image, r"^data:([^;,]*)", 1)).otherwise(F.lit("image/jpeg"))
    body = F.when(url, F.substring_index(image, ",", -1)).otherwise(image)
    return F.when(image.isNotNull(), F.struct(mime.alias("mime"), F.unbase64(body).alias("data")))


def snippet(text: Column, size: int = 300) -> Column:
    return F.substring(text, 1, size)


def printed_snippet(text: Column, size: int = 300) -> Column:
    """A snippet on one line, with dots if it was cut."""
    cut = F.replace(F.substring(text, 1, size), F.lit("\n"), F.lit(" "))
    return F.when(F.length(text) > size, F.concat(cut, F.lit("..."))).otherwise(cut)

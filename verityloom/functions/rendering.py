"""Exact text forms of elements, annotations and facts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verityloom.functions.hashing import content_id


def element_id(
    document: Column, kind: Column, unit: Column, order: Column, discriminator: Column, extra: Column
) -> Column:
    """The content-derived identity of an element from its six parts."""
    return content_id(
        discriminator=discriminator, document_id=document, element_type=kind, extra=extra, order_index=order, unit=unit
    )


def list_item(text: Column, depth: Column, ordered: Column, number: Column) -> Column:
    """A list item: two blanks a level, then its number and a full stop, or a dash."""
    mark = F.when(ordered & number.isNotNull(), F.concat(number.cast("string"), F.lit("."))).otherwise(F.lit("-"))
    return F.concat(F.repeat(F.lit("  "), F.coalesce(depth, F.lit(0))), mark, F.lit(" "), F.coalesce(text, F.lit("")))


def table_text(rows: Column) -> Column:
    """array<array<string>> as lines of cells between bars; a null cell is empty and bars and line ends inside are escaped."""
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.array_join(
        F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))), "\n"
    )


def visual_fact(subject: Column, attribute: Column, value: Column, unit: Column) -> Column:
    """subject: attribute = value unit, without what is null."""
    said = F.concat_ws(" ", F.concat(attribute, F.lit(" =")), value, unit)
    return F.concat_ws(": ", subject, F.when(said != "", said))


def diagram_edge(source: Column, label: Column, target: Column) -> Column:
    return F.concat(
        source,
        F.when(label.isNull() | (label == ""), F.lit(" -> ")).otherwise(F.concat(F.lit(" -["), label, F.lit("]-> "))),
        target
    )


def annotation(kind: Column, text: Column, derived: Column) -> Column:
    """How an annotation is shown, by its kind; identifiers are never shown and derived ones are marked."""
    label = F.when(kind == "caption", "Caption: ").when(
        kind == "ocr", "Text in picture: "
    ).when(kind == "visual_fact", "Fact: ").when(kind == "diagram", "Diagram: ")
    shown = F.concat(F.coalesce(label, F.lit("")), text)
    return F.when(
        (kind == "identifier") | text.isNull(), F.lit(None)
    ).when(derived, F.concat(F.lit("[derived] "), shown)).otherwise(shown)


def portable_path(path: Column) -> Column:
    """Whether a path is relative, without drive, backslash or a step upward."""
    return path.isNotNull() & (path != "") & ~path.rlike(r"^/|^[A-Za-z]:|\\") & ~path.rlike(r"(^|/)\.\.(/|$)")


def fact_matches(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Two facts agree: every field is equal, nulls to nulls; fields that read as numbers are compared as numbers, others as trimmed text in lower case."""
    one = F.lit(True)
    for k in a:
        x, y = a[k].cast("string"), b[k].cast("string")
        nx, ny = x.try_cast("double"), y.try_cast("double")
        one = one & F.when(nx.isNotNull() & ny.isNotNull(), nx == ny).otherwise(
            F.lower(F.trim(x)).eqNullSafe(F.lower(F.trim(y)))
        )
    return one

"""XML columns: well-formedness, pretty-printing, XPath."""

from __future__ import annotations

import xml.parsers.expat as expat
from xml.dom import minidom
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def xml_error(text: str | None) -> str | None:
    """``line:column: reason`` of the first error; null for a well-formed document and for null."""
    if text is None:
        return None
    p = expat.ParserCreate()
    try:
        p.Parse(text.encode("utf-8", "replace"), True)
    except expat.ExpatError as e:
        return f"{e.lineno}:{e.offset}: {expat.errors.messages[e.code]}"
    return None


def pretty(text: str | None, indent: str = "  ") -> str | None:
    """The document with an element a line; elements that hold text stay on one line, as white space counts there. Null if it is not well-formed."""
    if text is None or xml_error(text):
        return None

    def lines(e: minidom.Element, depth: int) -> list[str]:
        tag = e.tagName + "".join(f" {k}={quoteattr(v)}" for k, v in e.attributes.items())
        if not e.childNodes:
            return [f"{indent * depth}<{tag}/>"]
        if any(c.nodeType in (c.TEXT_NODE, c.CDATA_SECTION_NODE) and c.data.strip() for c in e.childNodes):
            inner = "".join(escape(c.data) if c.nodeType in (c.TEXT_NODE, c.CDATA_SECTION_NODE) else c.toxml() for c in e.childNodes)
            return [f"{indent * depth}<{tag}>{inner}</{e.tagName}>"]
        inside = [x for c in e.childNodes if c.nodeType == c.ELEMENT_NODE for x in lines(c, depth + 1)]
        return [f"{indent * depth}<{tag}>", *inside, f"{indent * depth}</{e.tagName}>"]

    return "\n".join(lines(minidom.parseString(text.encode("utf-8", "replace")).documentElement, 0))


def well_formed(xml: Column) -> Column:
    """Whether a text is a well-formed document; null for null. By Arrow batches: the JVM has no such test."""

    @pandas_udf(StringType())
    def error(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "" if t is None else xml_error(t) or "")

    return F.when(xml.isNotNull(), error(xml) == "")


def error_of(xml: Column) -> Column:
    return pandas_udf(lambda texts: texts.map(xml_error), StringType())(xml)


def pretty_printed(xml: Column, indent: str = "  ") -> Column:
    return pandas_udf(lambda texts: texts.map(lambda t: pretty(t, indent)), StringType())(xml)


def xpath_all(xml: Column, path: str) -> Column:
    """array<string> of all nodes an XPath finds; null for null and for what is not well-formed."""
    return F.when(well_formed(xml), F.xpath(xml, F.lit(path)))


def xpath_first(xml: Column, path: str) -> Column:
    """The text of the first node an XPath finds, '' if there is none; null for null and for what is not well-formed."""
    return F.when(well_formed(xml), F.xpath_string(xml, F.lit(path)))

"""Text projections over raw event fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The 29 code points that count as blank at either end of a text.
# tab, line feed, vertical tab, form feed, carriage return, the four
# information separators, space, next line, no-break space, ogham space, the
# eleven general-punctuation spaces, line and paragraph separators, narrow
# no-break space, medium mathematical space, ideographic space.
BLANK_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_blank(text: Column) -> Column:
    """Remove blank characters at both ends (Unicode-aware, unlike ``trim``)."""
    return F.btrim(text, F.lit(BLANK_CHARS))


def decode_text(raw: Column) -> Column:
    """UTF-8 bytes to text, dropping invalid bytes; NULL stays NULL.

    Valid input is passed through untouched, so a genuine U+FFFD survives there.
    """
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(
        F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    )


def decode_keys(fields: Column) -> Column:
    """Decode the field names of a feed to text; NULL becomes an empty map.

    Names that become equal without their invalid bytes are one field, the last.
    """
    entries = F.transform(F.map_entries(fields), lambda e: F.struct(decode_text(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,binary>"))


def field_text(fields: Column, name: str, default: str = "") -> Column:
    """The text of one field of a MAP<STRING, BINARY>, ``default`` when absent."""
    return F.coalesce(decode_text(F.try_element_at(fields, F.lit(name))), F.lit(default))


def blank_to_null(text: Column) -> Column:
    """Empty text becomes NULL."""
    return F.nullif(text, F.lit(""))

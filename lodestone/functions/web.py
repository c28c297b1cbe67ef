"""URLs, HTML and loose JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.markup import page_date, page_text, title  # noqa: F401  (pages are read as trees)


def url_fetch_key(u: Column) -> Column:
    """The URL without its fragment; path parameters and query stay."""
    return F.regexp_replace(F.trim(u), "#.*$", "")


def url_pool_key(u: Column) -> Column:
    """scheme://host/path?query: no fragment, no parameters of the last path segment, no empty query, no slashes at the end.

    The scheme is lowered; a URL without one keeps the mark behind it, and an empty or null URL is ''.
    """
    bare = F.regexp_replace(F.trim(u), "(?s)#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(bare, r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//)?", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^([^?]*)", 1), r";[^/]*$", "")
    query = F.regexp_extract(rest, r"(?s)^[^?]*(\?.+)$", 1)
    return F.when(F.coalesce(F.trim(u), F.lit("")) == "", F.lit("")).otherwise(F.regexp_replace(F.concat(scheme, F.lit("://"), path, query), "/+$", ""))


def source_urls(s: Column) -> Column:
    """The URLs in a field, parted by <br> or blanks, trailing .,; cut, each once in order."""
    found = F.regexp_extract_all(F.regexp_replace(s, "(?i)<br */?>", "\n"), F.lit(r"(https?://[^\s<>\"]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.rtrim(x, F.lit(".,;"))))


def text_fragment(u: Column) -> Column:
    """(prefix, start, end, suffix) of a URL's first text directive, decoded; null where there is none."""
    directive = F.regexp_extract(u, r"#(?:.*?):~:text=([^&]*)", 1)
    parts = F.split(directive, ",", -1)
    prefix = F.when(F.get(parts, F.lit(0)).endswith("-"), F.get(parts, F.lit(0)))
    at = F.when(prefix.isNotNull(), 1).otherwise(0)
    start, second, third = F.get(parts, at), F.get(parts, at + 1), F.get(parts, at + 2)
    end = F.when(~F.coalesce(second, F.lit("-")).startswith("-"), second)
    suffix = F.coalesce(F.when(second.startswith("-"), second), F.when(third.startswith("-"), third))
    return F.when(
        directive != "",
        F.struct(F.try_url_decode(F.regexp_replace(prefix, "-$", "")).alias("prefix"), F.try_url_decode(start).alias("start"), F.try_url_decode(end).alias("end"), F.try_url_decode(F.regexp_replace(suffix, "^-", "")).alias("suffix")),
    )


def collapsed(c: Column) -> Column:
    """A text lowered, blanks collapsed to one and cut from its ends; a null one is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def cited_span(text: Column, start: Column, reach: int = 400, end: Column | None = None) -> Column:
    """What stands around the first place of a quotation, up to `reach` characters on both sides; null if it is not there.

    Text and quotation are compared lowered and with blanks collapsed, and the span is cut from that form. A quotation
    with an end reaches to the first place of it behind its start, if there is one.
    """
    # the text in its normal form and the places in it are bound by lambdas, so that each is made once
    bound = lambda c, f: F.transform(F.array(c), f)[0]

    def around(page: Column, first: Column) -> Column:
        def cut(at: Column) -> Column:
            stop = at + F.length(first)
            begin = F.greatest(F.lit(1), at - reach)
            whole = lambda stop: F.substring(page, begin, stop - begin + reach)
            if end is None:
                return F.when((first != "") & (at > 0), whole(stop))
            last = collapsed(end)
            found = F.when((first != "") & (at > 0), F.call_function("locate", last, page, stop))
            return bound(found, lambda found: F.when(found.isNotNull(), whole(F.when((last != "") & (found > 0), found + F.length(last)).otherwise(stop))))

        return bound(F.instr(page, first), cut)

    return bound(collapsed(text), lambda page: around(page, collapsed(start)))


def verdict(reply: Column, key: str = "verdict") -> Column:
    """A judging model's verdict: JSON in or out of a code fence, else the bare field, else null."""
    bare = F.trim(F.regexp_replace(reply, "(?s)^\\s*```[a-z]*|```\\s*$", ""))
    parsed = F.get_json_object(F.when(bare.rlike(r"(?s)^\{.*\}$"), bare), f"$.{key}")
    return F.lower(F.coalesce(parsed, F.nullif(F.regexp_extract(reply, rf'(?i)"?{key}"?\s*[:=]\s*"?(true|false|yes|no)', 1), F.lit("")))).isin("true", "yes")


def judged_correct(reply: Column, key: str = "correct") -> Column:
    """Whether a judging model's JSON reply, in a code fence or not, has a value for the key that counts as true; null if it cannot be told.

    False are false, null, 0, an empty text, list or object; all else is true. A reply that is no JSON object with the key
    counts by its first `"key": true` or `false`.
    """
    bare = F.trim(F.regexp_replace(F.trim(reply), r"(?m)^```(?:json)?|```$", ""))
    whole = F.try_parse_json(bare)
    has = F.coalesce(F.array_contains(F.json_object_keys(F.when(whole.isNotNull(), bare)), key), F.lit(False))
    value = F.try_variant_get(whole, f"$.{key}", "string")
    kind = F.schema_of_variant(F.try_variant_get(whole, f"$.{key}", "variant"))
    number = value.try_cast("double")
    false = value.isNull() | (value == "") | ((kind == "BOOLEAN") & (value == "false")) | ((kind != "STRING") & F.coalesce(number == 0, F.lit(False))) | (~F.coalesce(kind == "STRING", F.lit(False)) & value.isin("{}", "[]"))
    spelled = F.lower(F.nullif(F.regexp_extract(bare, rf'(?i)"{key}"\s*:\s*(true|false)', 1), F.lit("")))
    return F.when(has, ~false).otherwise(spelled == "true")

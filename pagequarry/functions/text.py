"""Column expressions for scraped text: url identity, prices, codes, entities."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = "utm_[a-z]+|ref|gclid|fbclid"
DECIMAL = "decimal(18,2)"
SYMBOLS = {"€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "$": "USD"}
CODES = ["USD", "EUR", "GBP", "JPY", "INR", "CHF", "CAD", "AUD", "SEK", "PLN"]
COMMA_LANGS = ["de", "fr", "es", "it", "nl", "pt", "pl"]
POINT_CURRENCIES = ["USD", "GBP", "JPY", "INR", "CAD", "AUD"]
#: Named entities of HTML 4 and their code points.
ENTITIES = {**name2codepoint, "apos": 39}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def decode_entities(text: Column) -> Column:
    """Named and numeric entities, each once: ``&amp;lt;`` gives ``&lt;``. What names no character stays as it is."""
    return let(text, _decoded)


def _decoded(text: Column) -> Column:
    named = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in ENTITIES.items())), F.lit(","), F.lit(":"))
    entity = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});"

    def one(part: Column, at: Column) -> Column:
        def decoded(name: Column) -> Column:
            code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 7)).otherwise(F.try_element_at(named, name)).try_cast("int")
            valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
            char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
            return F.when((name != "") & valid, F.concat(char, F.substr(part, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), part))

        return F.when(at == 0, part).otherwise(let(F.regexp_extract(part, entity, 1), decoded))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&"), one), "")).otherwise(text)


def url_key(url: Column) -> Column:
    """Page identity: host without ``www.`` or ``m.``, path without ``.html`` or a final slash, sorted query without
    tracking; null for a null url or one that can't be parsed."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"(?:\.html)?/?$", "")
    pairs = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda x: (x != "") & ~x.rlike(f"^(?:{TRACKING})(?:=|$)"))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def currency(text: Column) -> Column:
    """A three-letter code in the text, else the code of a currency symbol, else null."""
    code = F.regexp_extract(F.upper(text), rf"(?:^|[^A-Z])({'|'.join(CODES)})(?:[^A-Z]|$)", 1)
    symbol = F.coalesce(*[F.when(F.contains(text, F.lit(s)), F.lit(c)) for s, c in SYMBOLS.items()])
    return F.when(code != "", code).otherwise(symbol)


def price(text: Column, lang: Column) -> Column:
    """``decimal(18,2)`` of a price as people write it; null if unreadable or ambiguous.

    With both separators the later one is decimal. One separator before other than three digits is decimal. Before three
    digits the language decides, then the currency, else the price is ambiguous."""
    run = F.regexp_replace(F.regexp_extract(text, r"(\d[\d.,'’   ]*)", 1), r"['’   ]|[.,]$", "")
    return let(F.regexp_replace(run, r"[.,]+$", ""), lambda run: _number(run, text, lang))


def _number(run: Column, text: Column, lang: Column) -> Column:
    comma, point = F.contains(run, F.lit(",")), F.contains(run, F.lit("."))
    comma_decimal = F.when(F.lower(F.substring(lang, 1, 2)).isin(COMMA_LANGS), F.lit(True)).when(lang.isNotNull() & (lang != ""), F.lit(False)).when(currency(text).isin(POINT_CURRENCIES), F.lit(False))
    as_point = F.replace(run, F.lit(","), F.lit(""))
    as_comma = F.replace(F.replace(run, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    last_comma = F.length(run) - F.instr(F.reverse(run), ",")
    last_point = F.length(run) - F.instr(F.reverse(run), ".")
    grouped = let(comma_decimal, lambda decimal: F.when(decimal, as_comma).when(~decimal, as_point))
    only = (
        F.when(run.rlike(r"^\d+[.,]\d{3}$"), grouped)
        .when(run.rlike(r"^\d{1,3}(?:[.,]\d{3}){2,}$"), F.regexp_replace(run, "[.,]", ""))
        .otherwise(F.replace(run, F.lit(","), F.lit(".")))
    )
    number = F.when(comma & point, F.when(last_comma > last_point, as_comma).otherwise(as_point)).when(comma | point, only).otherwise(run)
    return let(number, lambda number: F.when(number != "", number.try_cast(DECIMAL)))


def gtin_valid(code: Column) -> Column:
    """Whether the text is a GTIN-8, 12, 13 or 14 with the right check digit; false for null."""
    digits = F.lpad(code, 14, "0")
    total = sum((F.substring(digits, i + 1, 1).try_cast("int") * (1 if i % 2 else 3) for i in range(14)), F.lit(0))
    return F.coalesce(code.rlike(r"^(?:\d{8}|\d{12,14})$") & (total % 10 == 0), F.lit(False))

"""Removing credentials and personal data from text, in one pass over it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what stands in the place of what is removed.
MARKER = "[REDACTED]"
#: Names of settings that hold secrets.
SECRET_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "credential", "private_key")

_NAMES = "|".join(sorted(SECRET_NAMES, key=len, reverse=True))
#: What each form looks like; a named group before the secret is kept.
FORMS = {
    # The password between a user and a host: anything up to the last @ of the authority.
    "uri password": r"(?<=://)(?<user>[^\s/?#:@]*:)[^\s/?#]+(?=@)",
    # name = value or "name": "value"; a quoted value ends with its quote, a bare one at a separator.
    "setting": rf"(?<name>(?i:{_NAMES})[\"']?\s*[=:]\s*)(?:(?<quote>[\"'])(?:\\.|(?!\k<quote>)[^\\])+|(?i:(?:bearer|basic)\s+)?[^\s\"'\[\]{{}},;&]+)",
    "bearer": r"(?<scheme>(?i:\bbearer)\s+)[\w.~+/-]{6,}=*",
    "cloud key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "json web token": r"\beyJ[\w-]{5,}\.[\w-]{5,}\.[\w-]+",
    "private key": r"-----BEGIN (?<key>[A-Z ]*PRIVATE KEY)-----[\s\S]*?-----END \k<key>-----",
    "mail address": r"[\w.+%-]+@(?:[\w-]+\.)+\p{L}{2,}",
    # Area 000, 666 and 900 and above were never given out.
    "social security number": r"(?<!\d)(?!000|666|9)\d{3}(?<dash>[ -])\d{2}\k<dash>\d{4}(?!\d)",
}
_ANY = "|".join(FORMS.values())
#: The kept groups, in order; those of other forms than the one that matched are empty.
_KEPT = "${user}${name}${quote}${scheme}" + MARKER
#: A text without any of these has nothing to remove but, maybe, a card number.
_HINT = rf"[@=:]|AKIA|ASIA|eyJ|-----BEGIN|(?i:bearer)|\d[ -]\d\d[ -]\d"
_CARD = r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"


def luhn(number: Column) -> Column:
    """Whether the digits of a text have a right check digit: every second one from the right doubled, the sum of digits divisible by ten."""
    digits = F.reverse(F.regexp_replace(number, r"\D", ""))
    each = F.transform(F.filter(F.split(digits, ""), lambda d: d != ""), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def redact(c: Column) -> Column:
    """Text without URI passwords, secrets in settings, tokens, private keys, e-mail addresses, and social security and card numbers.

    A card number is 13 to 19 digits, in groups or not, with a right check digit. Null stays null.
    """
    cards = F.filter(F.regexp_extract_all(c, F.lit(_CARD), F.lit(0)), luhn)
    without = F.when(c.rlike(_CARD), F.aggregate(cards, c, lambda t, x: F.replace(t, x, F.lit(MARKER)))).otherwise(c)
    return F.when(c.rlike(_HINT), F.regexp_replace(without, _ANY, _KEPT)).otherwise(without)

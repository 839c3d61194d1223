"""Magnet links.  ``parse_url`` knows no opaque URIs, so the query is taken apart by string functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "abcdefghijklmnopqrstuvwxyz234567")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` uses it: inside a lambda it is a variable."""
    return F.transform(F.array(value), body)[0]


def _pairs(url: Column) -> Column:
    """The ``name=value`` texts of a query, which is what follows the first question mark; the fragment does not count."""

    def query(bare: Column) -> Column:
        return F.when(F.instr(bare, "?") > 0, F.substring(bare, F.instr(bare, "?") + 1, F.lit(1_000_000_000))).otherwise(F.lit(""))

    return F.split(bound(F.substring_index(url, "#", 1), query), "&")


def _values(pairs: Column, name: str) -> Column:
    own = F.filter(pairs, lambda p: F.startswith(p, F.lit(f"{name}=")) & (F.length(p) > len(name) + 1))
    raw = F.transform(own, lambda p: F.substring(p, len(name) + 2, 1_000_000_000))
    # A percent sign without two hexadecimal digits stands for itself; the rest of the value is decoded all the same.
    return F.transform(raw, lambda v: F.url_decode(F.regexp_replace(v, "%(?![0-9A-Fa-f]{2})", "%25")))


def query_values(url: Column, name: str) -> Column:
    """Decoded non-blank values of a query parameter, in order; the fragment does not count.  A plus sign is a space."""
    return _values(_pairs(url), name)


def infohash_to_base32(hex40: Column) -> Column:
    """Lower-case base32 of 40 hexadecimal digits; 40 bits at a time fit a long."""
    return F.concat(*(F.translate(F.lpad(F.conv(F.substring(hex40, 10 * i + 1, 10), 16, 32), 8, "0"), *_BASE32) for i in range(4)))


def base32_to_infohash(text: Column) -> Column:
    """The 40 hexadecimal digits of 32 base32 digits."""
    digits = F.translate(F.lower(text), _BASE32[1], _BASE32[0])
    return F.lower(F.concat(*(F.lpad(F.conv(F.substring(digits, 8 * i + 1, 8), 32, 16), 10, "0") for i in range(4))))


def parse_magnet(magnet: Column, accept_base32: bool = False) -> Column:
    """struct<ok, btih, dn, trackers, infohash_hex, infohash_base32, errors>.

    Errors are not_magnet, missing_btih and invalid_btih.  Hashes of 32 base32 digits are invalid unless ``accept_base32``.
    """
    none = F.array().cast("array<string>")

    def fields(link: Column, pairs: Column, found: Column) -> Column:
        is_magnet = F.coalesce(F.startswith(link, F.lit("magnet:?")), F.lit(False))
        btih = F.when(is_magnet, F.nullif(found, F.lit("")))
        hexed = F.when(btih.rlike("^[A-Fa-f0-9]{40}$"), F.lower(btih))
        if accept_base32:
            hexed = F.coalesce(hexed, F.when(btih.rlike("^[A-Za-z2-7]{32}$"), base32_to_infohash(btih)))

        def whole(digits: Column) -> Column:
            errors = (
                F.when(~is_magnet, F.array(F.lit("not_magnet")))
                .when(btih.isNull(), F.array(F.lit("missing_btih")))
                .when(digits.isNull(), F.array(F.lit("invalid_btih")))
                .otherwise(none)
            )
            return F.struct(
                (F.size(errors) == 0).alias("ok"),
                btih.alias("btih"),
                F.when(is_magnet, F.get(_values(pairs, "dn"), 0)).alias("dn"),
                F.when(is_magnet, _values(pairs, "tr")).otherwise(none).alias("trackers"),
                digits.alias("infohash_hex"),
                F.when(digits.isNotNull(), infohash_to_base32(digits)).alias("infohash_base32"),
                errors.alias("errors"),
            )

        return bound(hexed, whole)

    def hashed(pairs: Column) -> Column:
        return F.regexp_extract(F.coalesce(F.get(_values(pairs, "xt"), 0), F.lit("")), r"urn:btih:([A-Za-z0-9]+)", 1)

    # The link, its query, the hash as found and its digits are each evaluated once; inlined they would multiply.
    return bound(magnet, lambda link: bound(_pairs(link), lambda pairs: bound(hashed(pairs), lambda found: fields(link, pairs, found))))


def with_mismatch(errors: Column, expected: Column, found: Column) -> Column:
    """Adds infohash_mismatch where fetched metadata belongs to another hash; errors come back sorted and distinct."""
    differs = F.coalesce(expected != found, F.lit(False))
    return F.array_sort(F.array_union(errors, F.when(differs, F.array(F.lit("infohash_mismatch"))).otherwise(F.array().cast("array<string>"))))

"""Number normalisation and stable record ids.

A number is first *classified* into one form, then its canonical spelling,
country and type are rendered from that form. Both steps are plain columns,
staged so that shared parts are computed once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import strip_noise, strip_space

NUMBER_FIELDS = ("raw_number", "normalized_number", "country", "patent_type", "is_placeholder")


# Forms of a number. The first five belong to the home country.
CODE, REISSUE, DESIGN, PUBLICATION, UTILITY, PREFIXED, BARE, HINTED, UNKNOWN, MISSING, NOISE = range(11)

_HOME = fv.HOME_COUNTRY
# Record type per form; codes and bare numbers depend on more than the form.
_TYPES = (None, "reissue", "design", "publication", "utility", "foreign", "foreign", "foreign",
          "unknown", "unknown", "unknown")
# What stands between the country and the digits.
_INFIX = ("", "RE", "D", *[""] * 8)


def _lookup(values: tuple, form: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), form)


def _form(hint: Column) -> Column:
    """Form of a number from the staged columns; the first that fits wins."""
    raw, body = F.col("_raw"), F.col("_body")
    at_home = body.startswith(_HOME)
    return (
        F.when(raw.isNull(), MISSING)
        .when(F.upper(raw).isin(*fv.PLACEHOLDER_TYPES), CODE)
        .when(body == "", NOISE)
        .when(body.rlike(f"^({_HOME})?RE.*[0-9]"), REISSUE)
        .when(F.col("_design") != "", DESIGN)
        .when(body.rlike(f"^{_HOME}[0-9]{{11}}([A-Z][0-9]?)?$"), PUBLICATION)
        .when(F.col("_known") & at_home & (F.col("_home") != ""), UTILITY)
        .when(F.col("_known") & (F.col("_rest") != ""), PREFIXED)
        .when(body.rlike(r"^[0-9][0-9A-Z.\-]*$"), BARE)
        .when(hint.isNotNull(), HINTED)
        .otherwise(UNKNOWN)
    )


def with_number(df: DataFrame, raw: Column, hint: Column | None = None, prefix: str = "",
                exact_unicode: bool = True) -> DataFrame:
    """Append the fields of NUMBER_FIELDS, each name led by ``prefix``.

    ``hint`` is a country known from elsewhere: it labels bare numbers and
    makes a leading home-country prefix of a foreign record noise.

    Shared parts are staged as columns, and forms are small integers: together
    with the callers' columns the generated method stays below the size up to
    which the JVM compiles it.
    """
    hint = F.lit(None).cast("string") if hint is None else hint
    text = strip_space(raw)
    staged = df.withColumns({"_raw": text, "_hint": hint})
    staged = staged.withColumn("_raw", F.when(~F.col("_raw").rlike("^(?i:nan)?$"), F.col("_raw")))
    staged = staged.withColumn("_body", strip_noise(F.col("_raw"), exact_unicode))

    body, hint = F.col("_body"), F.col("_hint")
    misplaced = (hint != _HOME) & body.startswith(_HOME) & (F.length(body) > 2)
    staged = staged.withColumn("_body", F.when(misplaced, F.substr(body, F.lit(3))).otherwise(body))

    rest = F.substr(body, F.lit(3))
    staged = staged.withColumns({
        "_design": F.regexp_extract(body, f"^(?:{_HOME})?D([0-9]+)", 1),
        "_known": body.rlike("^(" + "|".join(fv.COUNTRY_PREFIXES) + ")."),
        "_home": F.regexp_replace(rest, fv.HOME_KIND_CODE + "|[^0-9]", ""),
        "_rest": F.regexp_replace(rest, "[A-Z][0-9]?$", ""),
    })
    staged = staged.withColumn("_form", _form(hint))

    form = F.col("_form")
    country = (
        F.when(form <= UTILITY, _HOME)
        .when(form == PREFIXED, F.left(body, F.lit(2)))
        .when(form == BARE, F.coalesce(hint, F.lit(_HOME)))
        .when(form == HINTED, hint)
    )
    tail = (
        F.when(form == REISSUE, F.regexp_replace(body, "[^0-9]", ""))
        .when(form == DESIGN, F.col("_design"))
        .when(form == PUBLICATION, F.regexp_replace(rest, "^([0-9]{11})$", "$1A1"))
        .when(form == UTILITY, F.col("_home"))
        .when(form == PREFIXED, F.col("_rest"))
        .when(form.between(BARE, UNKNOWN), body)
    )
    staged = staged.withColumns({"_country": country, "_tail": tail})
    country = F.col("_country")
    codes = F.create_map(*[F.lit(x) for item in fv.PLACEHOLDER_TYPES.items() for x in item])
    kind = (
        F.when(form == CODE, F.try_element_at(codes, F.upper(F.col("_raw"))))
        .when((form == BARE) & (country == _HOME), "utility")
        .otherwise(_lookup(_TYPES, form))
    )
    number = F.concat(F.coalesce(country, F.lit("")), _lookup(_INFIX, form), F.col("_tail"))
    values = dict(zip(NUMBER_FIELDS, (F.col("_raw"), number, country, kind, form.isin(MISSING, CODE, NOISE))))
    # The fields leave as a one-row generator: filters on them stay above it.
    # Pushed below, each would be rewritten in terms of the raw text, and the
    # staged columns would multiply out into a plan of millions of nodes.
    fields = F.struct(*[v.alias(prefix + n) for n, v in values.items()])
    return staged.select(*df.columns, F.inline(F.array(fields)))


def synthetic_number(country: Column, raw: Column) -> Column:
    """Key for a foreign number that has no canonical form."""
    return F.concat(country, F.regexp_replace(F.upper(raw), r"(?U)[^\p{Alnum}]", ""))


def stable_id(seed: Column) -> Column:
    """Version-5 UUID of the seed in the URL namespace."""
    namespace = F.unhex(F.lit(fv.ID_NAMESPACE.replace("-", "")))
    name = F.encode(F.concat(F.lit(fv.ID_SEED_PREFIX), seed), "UTF-8")
    digest = F.sha1(F.concat(namespace, name))

    def part(start: int, length: int) -> Column:
        return F.substring(digest, start, length)

    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"),
                    variant, part(18, 3), F.lit("-"), part(21, 12))


def record_seed(number: Column, country: Column, raw: Column, row_index: Column) -> Column:
    """What an id is made from: the number, or the row it came from."""
    fallback = F.concat_ws("-", F.coalesce(country, F.lit("NA")), F.coalesce(raw, F.lit("NO_NUMBER")),
                           row_index.cast("string"))
    return F.coalesce(number, fallback)

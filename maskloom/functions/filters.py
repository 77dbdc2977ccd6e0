"""False-positive filters on findings (expressions over one row, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from maskloom.functions.spans import LEFT, RIGHT, SPACE, WORD, overlaps, regex_spans
from maskloom.policy import Policy

# Protected shapes, score floors, timestamp bands.
_URL_BODY = rf"""[^{SPACE}<>"')\]]"""
URL = rf"https?://{_URL_BODY}+"
TLDS = "com|org|net|io|app|ai|dev|co|sh|xyz|site|cloud"
DOMAIN = rf"(?<![@{WORD}])[{WORD}.-]+\.(?:{TLDS}){RIGHT}(?:/{_URL_BODY}*)?"
UUID = rf"{LEFT}[0-9a-fA-F]{{8}}(?:-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}{RIGHT}"
SLACK_ID = rf"{LEFT}[CUTWGDE][A-Z0-9]{{8,}}{RIGHT}"
PREFIX_ID = rf"{LEFT}[a-z]{{2,8}}_[A-Za-z0-9]{{8,}}{RIGHT}"
_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NOT_FINITE = r"(?<=[:\[,\s])(?:-?Infinity|NaN)(?=[\s,\]}])"
JSON_KEY = rf"{_JSON_STRING}(?=[{SPACE}]*:)"

SCORE_FLOORS = {"PERSON": 0.85, "LOCATION": 0.7, "ORGANIZATION": 0.7}
BASE_FLOOR = 0.4
EPOCH_BANDS = {10: (1_500_000_000, 2_500_000_000), 13: (1_500_000_000_000, 2_500_000_000_000)}

PROTECTED = "array<struct<kind:string,start:int,end:int>>"
_KINDS = {
    "json_key": JSON_KEY,
    "url": URL,
    "domain": DOMAIN,
    "uuid": UUID,
    "slack_id": SLACK_ID,
    "prefix_id": PREFIX_ID,
}
# cheap tests: found in every text the kind occurs in
_TESTS = {
    "json_key": '"',
    "url": "https?://",
    "domain": rf"\.(?:{TLDS}){RIGHT}",
    "uuid": "[0-9a-fA-F]-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-",
    "slack_id": "[CUTWGDE][A-Z0-9]{8}",
    "prefix_id": "[a-z]_[A-Za-z0-9]{8}",
}
ID_KINDS = ("uuid", "slack_id", "prefix_id")


def _finite(text: Column) -> Column:
    """For the test alone a non-finite number is a 0; inside strings that changes nothing."""
    some = F.contains(text, F.lit("NaN")) | F.contains(text, F.lit("Infinity"))
    return F.when(some, F.regexp_replace(text, _NOT_FINITE, "0")).otherwise(text)


def _parses(text: Column) -> Column:
    finite = _finite(text)
    # A closing bracket too many ends one of the wrappers early, but is an error in the other.
    listed = F.json_array_length(F.concat(F.lit("["), finite, F.lit("]")))
    held = F.json_object_keys(F.concat(F.lit('{"v":'), finite, F.lit("}")))
    quote = F.lit("'")
    bare = F.contains(text, quote) & F.contains(F.regexp_replace(text, _JSON_STRING, ""), quote)
    return listed.isNotNull() & held.isNotNull() & ~bare


#: The parser with its limits lifted and nothing allowed that JSON does not have.
_UNLIMITED = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "broken",
    "maxNestingDepth": "2147483647",
    "maxNumLen": "2147483647",
    "maxStringLen": "2147483647",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}
#: Characters of a key that the parser takes; no option lifts this.
_KEY_LIMIT = 50_000


def _parses_unlimited(text: Column) -> Column:
    """The text parses, whatever its depth and the length of its strings and numbers.

    The wrapped text is passed over, not copied. Of two wrappers one refuses a closing bracket too many.
    """
    finite = _finite(text)

    def sound(head: str, tail: str) -> Column:
        read = F.from_json(F.concat(F.lit(head), finite, F.lit(tail)), "none int, broken string", _UNLIMITED)
        return read.isNotNull() & read["broken"].isNull()

    return sound('{"v":', "}") & sound('{"v":[', "]}")


# Short objects of strings without escapes and short plain numbers, which need no parser.
_FLAT_STRING = r'"[^"\\\x00-\x1F]{0,400}+"'
_FLAT_VALUE = rf"(?:{_FLAT_STRING}|-?(?:0|[1-9][0-9]{{0,17}}+)|true|false|null)"
_FLAT = rf"(?s)\A(?=.{{2,1000}}\z)\{{{_FLAT_STRING}:{_FLAT_VALUE}(?:,{_FLAT_STRING}:{_FLAT_VALUE}){{0,20}}+\}}\z"

# What a JSON text is made of, for the walk below.
_SCALAR = r"(?s)[ \t\n\r]*(?:-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null|NaN|-?Infinity)[ \t\n\r]*"
_GOOD_STRING = r'(?s)"[^"\\\x00-\x1F]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1F]*+)*+"'
_TOKEN = rf'(?s){_JSON_STRING}|[{{}}\[\],:]|[^{{}}\[\],:"]++|"'
_CLOSED = r"(?s)\A[ \t\n\r]*+(?:\{.*\}|\[.*\])[ \t\n\r]*+\z"
#: The JVM parser refuses deep nesting and long strings, keys and numbers; none of these fits in fewer characters.
_PARSER_LIMIT = 1000


def _walks(text: Column) -> Column:
    """The same question decided token by token, without limits on depth or length.

    State: what may come next (value, Value or end of an empty array, key, Key or end of an
    empty object, colon, separator, end, x for an error) and the brackets that are open.
    """
    state = "struct<next:string,open:string>"

    def step(acc: Column, token: Column) -> Column:
        sign = F.left(token, F.lit(1))
        value_next = acc["next"].isin("v", "V")
        inside = F.right(acc["open"], F.lit(1))
        outer = F.left(acc["open"], F.length(acc["open"]) - 1)
        done = F.when(acc["open"] == "", F.lit("e")).otherwise(F.lit(","))
        closed = F.when(F.length(acc["open"]) <= 1, F.lit("e")).otherwise(F.lit(","))
        string, blank = sign == '"', token.rlike(r"^[ \t\n\r]*$")

        def to(next_: Column | str, open_: Column) -> Column:
            return F.struct((F.lit(next_) if isinstance(next_, str) else next_).alias("next"), open_.alias("open"))

        return (
            F.when(blank | (acc["next"] == "x"), acc)
            .when(string & ~token.rlike(rf"^(?:{_GOOD_STRING})$"), to("x", F.lit("")))
            .when(string & acc["next"].isin("k", "K"), to(":", acc["open"]))
            .when((sign == "{") & value_next, to("K", F.concat(acc["open"], sign)))
            .when((sign == "[") & value_next, to("V", F.concat(acc["open"], sign)))
            .when((sign == "}") & (inside == "{") & acc["next"].isin("K", ","), to(closed, outer))
            .when((sign == "]") & (inside == "[") & acc["next"].isin("V", ","), to(closed, outer))
            .when((sign == ",") & (acc["next"] == ","), to(F.when(inside == "{", F.lit("k")).otherwise(F.lit("v")), acc["open"]))
            .when((sign == ":") & (acc["next"] == ":"), to("v", acc["open"]))
            .when(value_next & (string | token.rlike(rf"^(?:{_SCALAR})$")), to(done, acc["open"]))
            .otherwise(to("x", F.lit("")))
        )

    start = F.struct(F.lit("v").alias("next"), F.lit("").alias("open")).cast(state)
    return F.aggregate(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), start, lambda acc, t: step(acc, t).cast(state), lambda acc: acc["next"] == "e")


def is_json(text: Column) -> Column:
    """The text parses and its root is an object or an array.

    White space around the root and non-finite numbers are taken, as common parsers do.
    Brackets put around it make the parser refuse anything after the root value; it also
    takes single quotes, which JSON does not, so quotes outside strings are refused.
    What the parser refuses may still be JSON past the parser's own limits; texts long
    enough for that go through a parser without these limits, and those with a key beyond the
    one limit that stays are decided by their tokens.
    """
    closed = text.rlike(_CLOSED)
    long_key = F.exists(F.regexp_extract_all(text, F.lit(_JSON_STRING), F.lit(0)), lambda s: F.length(s) > _KEY_LIMIT)
    beyond = F.when(_parses_unlimited(text), F.lit(True)).when(F.length(text) > _KEY_LIMIT, long_key & _walks(text)).otherwise(F.lit(False))
    parses = F.when(text.rlike(_FLAT), F.lit(True)).when(_parses(text), F.lit(True)).when(F.length(text) > _PARSER_LIMIT, beyond).otherwise(F.lit(False))
    return F.when(closed, parses).otherwise(F.lit(False))


def protected_spans(text: Column, kinds=tuple(_KINDS)) -> Column:
    """URLs, domains, ids and (in JSON text) object keys that findings must not touch."""

    def tagged(kind: str) -> Column:
        return F.transform(
            regex_spans(text, _KINDS[kind], _TESTS[kind]),
            lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
        )

    parts = []
    for kind in kinds:
        spans = tagged(kind)
        if kind == "json_key":
            spans = F.when(is_json(text), spans).otherwise(F.lit([]).cast(PROTECTED))
        parts.append(spans)
    return F.concat(*parts)


def unprotected(entity: Column, start: Column, end: Column, protected: Column) -> Column:
    """No protected span overlaps. Secrets are never protected; a domain never protects an email."""
    return (entity == "SECRET") | ~F.exists(
        protected,
        lambda p: overlaps(start, end, p["start"], p["end"])
        & ~((entity == "EMAIL_ADDRESS") & (p["kind"] == "domain")),
    )


def above_floor(entity: Column, score: Column) -> Column:
    floor = F.lit(BASE_FLOOR)
    for name, value in SCORE_FLOORS.items():
        floor = F.when(entity == name, F.lit(value)).otherwise(floor)
    return score >= floor


def named_shape_ok(entity: Column, value: Column) -> Column:
    """PERSON, LOCATION, ORGANIZATION: no underscore, not only digits."""
    bare = F.translate(F.trim(value), ".,", "")
    return ~entity.isin(*SCORE_FLOORS) | ~(F.contains(value, F.lit("_")) | bare.rlike(r"^\p{Nd}+$"))


def person_ok(entity: Column, value: Column, host_fragments=()) -> Column:
    bare = F.rtrim(F.trim(value), F.lit("."))
    bad = (F.length(bare) < 3) | value.rlike(r"\n|://|@|\p{Nd}")
    for fragment in host_fragments:
        bad = bad | F.contains(value, F.lit(fragment))
    return (entity != "PERSON") | ~bad


def not_timestamp(entity: Column, value: Column) -> Column:
    bare = F.trim(value)
    number = bare.try_cast("bigint")
    band = F.lit(False)
    for width, (low, high) in EPOCH_BANDS.items():
        band = band | ((F.length(bare) == width) & number.between(low, high))
    return (entity != "PHONE_NUMBER") | ~(bare.rlike("^[0-9]+$") & F.coalesce(band, F.lit(False)))


def allowed_word(value: Column, policy: Policy) -> Column:
    """True when the allow list covers the finding: exact term, or one of its words."""
    terms = sorted({t for term in policy.allow_list for t in (term, term.lower())})
    words = sorted({term.lower() for term in policy.allow_list if len(term) >= 3})
    hit = value.isin(*terms) if terms else F.lit(False)
    if words:
        listed = F.array(*[F.lit(w) for w in words])
        hit = hit | F.arrays_overlap(F.split(F.lower(F.trim(value)), rf"[{SPACE}]+"), listed)
    return hit


def allowed_vault_value(value: Column, policy: Policy) -> Column:
    """Vault values the allow list keeps out of the known-value scan."""
    terms = sorted({term.lower() for term in policy.allow_list})
    if not terms:
        return F.lit(False)
    tokens = F.split(F.lower(value), rf"[{SPACE}_\-./@]+")
    return F.lower(value).isin(*terms) | F.exists(tokens, lambda t: (F.length(t) >= 3) & t.isin(*terms))


def quality(policy: Policy) -> Column:
    """Score floor, shape, person, timestamp and allow-list tests on a findings row."""
    entity, value, score = F.col("entity_type"), F.col("value"), F.col("score")
    return (
        above_floor(entity, score)
        & named_shape_ok(entity, value)
        & person_ok(entity, value, policy.host_fragments)
        & not_timestamp(entity, value)
        & ~allowed_word(value, policy)
    )

"""Deterministic fake values: HMAC-SHA256 of type and value picks words from fixed lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from maskloom.runtime import computed

# Own word material. First and last names are built from syllables, so that the pools
# (5 760 and 19 200 words) stay useful for large vaults.
ONSETS = "B,Br,C,Cl,D,Dr,F,G,Gr,H,J,K,L,M,N,P,R,S,St,T,Th,V,W,Z".split(",")
NUCLEI = "a,e,i,o,u,ae,ia,eo,ai,ou".split(",")
ENDINGS = "bel,can,dor,den,fin,gan,lan,len,lia,lin,mar,mir,na,nel,nor,ra,ren,rin,sa,son,tan,tia,van,vin".split(",")
STEMS = (
    "Ash,Black,Brook,Cald,Cliff,Cran,Dun,East,Elm,Fair,Farn,Glen,Green,Hart,Hazel,Hill,Holm,Kings,Lang,Linden,"
    "Long,Marsh,Mead,Mill,Moor,North,Oak,Pem,Pres,Quarry,Raven,Red,Rock,Sand,Shel,South,Stan,Thorn,West,Wind"
).split(",")
LINKS = ",a,e,i,o,al,en,er,in,is,ing,on".split(",")
TAILS = (
    "bank,bourne,bridge,brook,bury,combe,cote,croft,dale,dean,den,don,field,ford,gate,grove,ham,haven,hurst,ington,"
    "land,ley,low,man,mere,mont,more,ridge,row,shaw,smith,stead,stoke,ton,vale,ville,ward,well,wick,worth"
).split(",")
STREETS = "Street,Avenue,Lane,Road,Court,Drive,Way,Place".split(",")
FIRMS = "Group,Partners,Works,Labs,Holdings,Supply,Systems,Trading".split(",")
DOMAINS = "example.com,example.net,example.org,mail.example.com,post.example.net".split(",")

# Words of syllables, a consonant and a vowel each, for values whose own words are taken.
CONSONANTS, VOWELS = "bdfgklmnprstvz", "aeiou"
SYLLABLES = len(CONSONANTS) * len(VOWELS)
SYLLABLE = f"(?:[{CONSONANTS}][{VOWELS}])"

FIRSTS = len(ONSETS) * len(NUCLEI) * len(ENDINGS)
LASTS = len(STEMS) * len(LINKS) * len(TAILS)


def hmac_hex(message: Column) -> Column:
    """HMAC-SHA256 with the pads of the policy table (``inner_pad``, ``outer_pad``)."""
    inner = F.sha2(F.concat(F.col("inner_pad"), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.col("outer_pad"), F.unhex(inner)), 256)


def mac_message(entity: Column, value: Column, attempt: Column | int = 0) -> Column:
    """``TYPE:value`` for the first attempt, ``TYPE:value:n`` for the later ones."""
    n = F.lit(attempt) if isinstance(attempt, int) else attempt
    tail = F.when(n > 0, F.concat(F.lit(":"), n.cast("string"))).otherwise(F.lit(""))
    return F.concat(entity, F.lit(":"), value, tail)


def seed_of(mac: Column) -> Column:
    """First four bytes, big-endian."""
    return F.conv(F.left(mac, F.lit(8)), 16, 10).cast("long")


def _pick(words: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index % len(words) + 1).cast("int"))


def _div(number: Column, by: int) -> Column:
    return F.floor(number / by).cast("long")


def _first_name(n: Column) -> Column:
    rest = _div(n, len(ONSETS))
    return F.concat(_pick(ONSETS, n), _pick(NUCLEI, rest), _pick(ENDINGS, _div(rest, len(NUCLEI))))


def _last_name(n: Column) -> Column:
    rest = _div(n, len(STEMS))
    return F.concat(_pick(STEMS, n), _pick(LINKS, rest), _pick(TAILS, _div(rest, len(LINKS))))


def syllable_word(number: Column, syllables: int) -> Column:
    """The word of a number below ``SYLLABLES ** syllables``; no two numbers have one word."""
    digits = [F.floor(number / SYLLABLES**i).cast("long") % SYLLABLES for i in range(syllables)]
    return F.concat(*[F.concat(_pick(list(CONSONANTS), d), _pick(list(VOWELS), _div(d, len(CONSONANTS)))) for d in digits])


def _fake(entity: Column, mac: Column, seed: Column, first: Column, last: Column, tag: Column) -> Column:
    """The surrogate of the kind the entity asks for; an unknown entity gets a name."""
    high = _div(seed, FIRSTS)
    return (
        F.when(
            entity == "EMAIL_ADDRESS",
            F.concat(F.lower(first), F.lit("."), F.lower(last), tag, F.lit("@"), _pick(DOMAINS, high)),
        )
        .when(entity == "LOCATION", last)
        .when(
            entity == "ADDRESS",
            F.concat((seed % 9000 + 100).cast("string"), F.lit(" "), last, F.lit(" "), _pick(STREETS, seed)),
        )
        .when(entity == "ORGANIZATION", F.concat(last, F.lit(" "), _pick(FIRMS, seed)))
        .when(entity == "URL", F.concat(F.lit("https://"), F.lower(last), tag, F.lit(".example.com/")))
        .when(entity == "SECRET", F.concat(F.lit("Zq"), F.substring(mac, 9, 20), F.lit("#7")))
        .otherwise(F.concat(first, F.lit(" "), last))
    )


def with_fake(df: DataFrame, out: str, attempt: Column | int = 0) -> DataFrame:
    """Add the surrogate candidate of ``(entity_type, real_value)`` for one attempt.

    Staged columns: the HMAC is computed once per row, not once per use.
    """
    names = [c for c in df.columns if c != out]
    staged = _seeded(df, attempt).withColumns({"__first": _first_name(F.col("__seed")), "__last": _last_name(_div(F.col("__seed"), FIRSTS))})
    made = _fake(F.col("entity_type"), F.col("__mac"), F.col("__seed"), F.col("__first"), F.col("__last"), F.substring("__mac", 9, 4))
    return staged.withColumn(out, made).select(*names, out)


def with_words(df: DataFrame, out: str, first: str, last: str) -> DataFrame:
    """Add the surrogate of ``(entity_type, real_value)`` with the words of two columns in it, each bounded by other signs."""
    made = _fake(F.col("entity_type"), F.col("__mac"), F.col("__seed"), F.col(first), F.col(last), F.lit(""))
    return _seeded(df).withColumn(out, made).drop("__mac", "__seed")


def _seeded(df: DataFrame, attempt: Column | int = 0) -> DataFrame:
    mac = hmac_hex(mac_message(F.col("entity_type"), F.col("real_value"), attempt))
    return computed(df, __mac=mac).withColumn("__seed", seed_of(F.col("__mac")))


def discriminator(length: int) -> Column:
    message = F.concat(F.col("entity_type"), F.lit(":"), F.col("real_value"), F.lit(":disambiguate"))
    return F.left(hmac_hex(message), F.lit(length))

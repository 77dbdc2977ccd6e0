import re

import pytest
from pyspark.sql import functions as F

from maskloom.functions.fpe import fpe
from maskloom.functions.surrogates import SYLLABLE, SYLLABLES, syllable_word
from maskloom.operators import assign as asg, demask, vault as v
from maskloom.policy import default_policy, policy_table
from maskloom.sources.vault_store import VaultStore

SEAL = "ab" * 32


@pytest.fixture(scope="module")
def vault(spark):
    rows = [
        ("PERSON", "John Smith", "Maria Rodriguez", 0, False),
        ("PERSON", "John", "Maria", 1, True),
        ("US_SSN", "123-45-6789", "831-24-5067", 2, False),
        ("US_SSN", "999-88-6789", "111-22-3333", 3, False),
        ("CREDIT_CARD", "4111-1111-1111-1111", "9999-8888-7777-6666", 4, False),
        ("SECRET", "a@b.com", "hidden#1", 5, False),
    ]
    return spark.createDataFrame(rows, v.VAULT)


def test_lookups(spark, vault):
    rows = spark.createDataFrame([("PERSON", "JOHN smith"), ("EMAIL_ADDRESS", "A@b.com"), ("PERSON", "zoe")], "entity_type string, real_value string")
    assert {r.real_value: r.surrogate for r in v.find_surrogate(rows, vault).collect()} == {"JOHN smith": "Maria Rodriguez", "A@b.com": None, "zoe": None}
    assert {r.real_value: r.surrogate for r in v.find_surrogate_anywhere(rows, vault).collect()} == {"JOHN smith": "Maria Rodriguez", "A@b.com": "hidden#1", "zoe": None}
    back = spark.createDataFrame([("X", "HIDDEN#1"), ("X", "nope")], "entity_type string, surrogate string")
    assert {r.surrogate: r.restored for r in v.restore(back, vault).collect()} == {"HIDDEN#1": "a@b.com", "nope": "nope"}
    assert {r.surrogate: r.found for r in demask.lookup(back.select("surrogate"), vault).collect()} == {"HIDDEN#1": True, "nope": False}


def test_partial_needs_one_match(spark, vault):
    rows = [("US_SSN", "***-**-6789"), ("US_SSN", "123-**-6789"), ("CREDIT_CARD", "XXXX-XXXX-XXXX-1111"), ("US_SSN", "xxx-xx-6789"), ("US_SSN", "***-**-0000")]
    got = v.reconcile(spark.createDataFrame(rows, "entity_type string, partial string"), vault)
    assert {r.partial: r.surrogate for r in got.collect()} == {"123-**-6789": "831-24-5067", "XXXX-XXXX-XXXX-1111": "9999-8888-7777-6666"}


def test_demask_longest_first(spark, vault):
    docs = spark.createDataFrame([(1, "Found Maria Rodriguez, SSN 831-24-5067"), (2, "MariaX maria"), (3, None)], "id int, text string")
    got = {r.id: (r.demasked, len(r.replacements)) for r in demask.demask(docs, ["id"], vault).collect()}
    assert got == {1: ("Found John Smith, SSN 123-45-6789", 2), 2: ("JohnX maria", 1), 3: (None, 0)}


def test_assignment_is_injective_and_order_free(spark, key):
    rules = policy_table(spark, default_policy(), key)
    people = [("PERSON", f"{f} {x}{y}", f"{i:05d}") for i, (f, x, y) in enumerate((f, x, y) for f in ("Ana", "Bo", "Cy") for x in "KLMNOP" for y in ("aa", "bb", "cc", "dd"))]
    odd = [("PERSON", "ana kaa", "9"), ("PERSON", "Ana", "90"), ("PERSON", "Zed", "91"), ("EMAIL_ADDRESS", "p@q.io", "92"), ("SECRET", "P@Q.io", "93"), ("PHONE_NUMBER", "123", "94"), ("PHONE_NUMBER", "none", "95"), ("OTHER", "x", "96")]
    values = spark.createDataFrame(people + odd, "entity_type string, real_value string, ord string")
    one = asg.assign(values.coalesce(1), v.empty_vault(spark), rules)
    many = asg.assign(values.repartition(6), v.empty_vault(spark), rules)
    rows = {tuple(r) for r in one.collect()}
    assert rows == {tuple(r) for r in many.collect()}
    owner = {}
    for r in one.collect():
        assert owner.setdefault(r.surrogate.lower(), r.real_value) == r.real_value
    reals = {r.real_value for r in one.collect()}
    assert "P@Q.io" not in reals and "none" not in reals and "x" not in reals and "ana kaa" not in reals
    assert {"Ana", "Bo", "Cy", "Zed", "p@q.io", "123"} <= reals
    assert asg.assign(values, one, rules).count() == 0


def test_exhausted_pool_deals_words(spark, key, monkeypatch):
    """One place name for five places and a vault that holds dealt words: all different, no suffix."""
    from maskloom.functions import surrogates

    monkeypatch.setattr(surrogates, "STEMS", ["Ash"])
    monkeypatch.setattr(surrogates, "LINKS", ["a"])
    monkeypatch.setattr(surrogates, "TAILS", ["ton"])
    rules = policy_table(spark, default_policy(), key)
    rows = [("LOCATION", f"city {i}", i) for i in range(5)] + [("PERSON", f"Ann Lee{i}", 5 + i) for i in range(40)]
    values = spark.createDataFrame(rows, "entity_type string, real_value string, ord int")
    vault = asg.assign(values, v.empty_vault(spark), rules)
    got = [r.surrogate for r in vault.where("not derived").collect()]
    assert len(set(got)) == 45 and sum(s == "Ashaton" for s in got) == 1 and not any("(" in s for s in got)
    later = spark.createDataFrame([(t, f"{r} more", o) for t, r, o in rows], "entity_type string, real_value string, ord int")
    more = [r.surrogate for r in asg.assign(later, vault, rules).where("not derived").collect()]
    assert len(set(more)) == 45 and not {s.lower() for s in more} & {s.lower() for s in got}
    dealt = [w for s in [*got, *more] for w in s.split() if is_dealt(w)]
    assert len(set(dealt)) == len(dealt)


def is_dealt(word):
    return re.fullmatch(f"(?i){SYLLABLE}{{3,8}}", word) is not None


def test_words_of_numbers_differ(spark):
    words = spark.range(SYLLABLES**3).select(syllable_word(F.col("id"), 3).alias("w"))
    assert words.distinct().count() == SYLLABLES**3 and words.where(F.col("w").rlike(f"^{SYLLABLE}{{3}}$")).count() == SYLLABLES**3


def test_store(spark, vault, tmp_path):
    for seal in (None, SEAL):
        store = VaultStore(spark, f"{tmp_path}/v-{seal is None}", seal)
        assert store.read().isEmpty()
        store.write(0, vault.where("seq < 3"))
        store.write(1, vault.where("seq >= 3"))
        store.write(1, vault.where("seq >= 3"))  # a replayed batch
        assert {tuple(r) for r in store.read().collect()} == {tuple(r) for r in vault.collect()}
        assert store.read(before=1).count() == 3
        store.compact()
        assert {tuple(r) for r in store.read().collect()} == {tuple(r) for r in vault.collect()}
        store.clear()
        assert store.read().isEmpty()
    raw = spark.read.parquet(f"{tmp_path}/v-False/segments").select("real_sealed", "real_index").first()
    assert len(raw.real_index) == 64 and b"John" not in bytes(raw.real_sealed)
    other = VaultStore(spark, f"{tmp_path}/v-False", "cd" * 32)
    other._generation = lambda: 0
    with pytest.raises(Exception):
        other.read().collect()


def test_sealed_lookups(spark, vault, tmp_path, monkeypatch):
    """As on the open vault, also after a value was written again, and only the hits are opened."""
    from maskloom.sources import vault_store

    store = VaultStore(spark, f"{tmp_path}/sealed", SEAL)
    later = spark.createDataFrame([("PERSON", "John Smith", "Ada Byron", 9, False)], v.VAULT)
    probes = [("PERSON", "john smith", "Maria Rodriguez"), ("PERSON", "John", "Maria"), ("US_SSN", "a@b.com", "831-24-5067"), ("SECRET", None, None), ("SECRET", "", "")]
    rows = spark.createDataFrame(probes, "entity_type string, real_value string, surrogate string")
    asked, replies = rows.drop("surrogate"), rows.drop("real_value")
    assert store.find_surrogate(asked).where("surrogate is not null").isEmpty()
    store.write(0, vault)
    store.write(1, later)
    opened, both = [], vault.union(later)
    unseal = vault_store.unseal
    monkeypatch.setattr(vault_store, "unseal", lambda found, key: opened.append(found.count()) or unseal(found, key))
    assert set(store.find_surrogate(asked).collect()) == set(v.find_surrogate(asked, both).collect())
    got = set(store.find_real(replies).collect())
    assert got == set(v.find_real(replies, both).collect())
    assert ("PERSON", "Maria Rodriguez", None) in {tuple(r) for r in got}
    assert opened == [4, 4]  # of 7 rows: both of John Smith, John, and the row with a@b.com or the number


def test_cipher_surrogates_are_no_real_values(spark, key):
    """Three digits, 400 of the 1000 numbers in use: the walk goes on until the number is free."""
    values = spark.createDataFrame([("PHONE_NUMBER", f"{i:03d}", i) for i in range(400)], "entity_type string, real_value string, ord int")
    made = asg.assign(values, v.empty_vault(spark), policy_table(spark, default_policy(), key)).collect()
    fresh = [r.surrogate for r in made]
    assert len(set(fresh)) == len(made) == 400
    assert not set(fresh) & {f"{i:03d}" for i in range(400)}


def test_dense_formats_keep_their_digits(spark, key):
    """Half of a six-digit format in use: nobody gets a suffix."""
    known = spark.range(500_000).select(F.lit("PHONE_NUMBER").alias("entity_type"), F.format_string("%06d", F.col("id") * 2).alias("real_value"), F.concat(F.lit("s"), "id").alias("surrogate"), F.col("id").alias("seq"), F.lit(False).alias("derived"))
    values = spark.range(6000).select(F.lit("PHONE_NUMBER").alias("entity_type"), F.format_string("%06d", F.col("id") * 150 + 1).alias("real_value"), F.col("id").alias("ord"))
    made = asg.assign(values, known, policy_table(spark, default_policy(), key)).collect()
    fresh = {r.surrogate for r in made}
    assert len(made) == len(fresh) == 6000 and all(len(s) == 6 and s.isdigit() and int(s) % 2 for s in fresh)
    assert not fresh & {r.real_value for r in made}


@pytest.mark.parametrize("n,suffixed", [(500, 0), (510, 20)])
def test_suffix_only_without_free_numbers(spark, key, n, suffixed):
    """Three digits: 500 values need all the 500 numbers left; of 510 values, 490 find one."""
    rows = [("PHONE_NUMBER", f"No {i:03d}" if i % 2 else f"NO {i:03d}", i) for i in range(n)] + [("PHONE_NUMBER", "9" * 40, n)]
    values = spark.createDataFrame(rows, "entity_type string, real_value string, ord int")
    made = asg.assign(values, v.empty_vault(spark), policy_table(spark, default_policy(), key)).collect()
    assert len({r.surrogate.lower() for r in made}) == len(made) == n + 1
    assert sum("(" in r.surrogate for r in made) == suffixed
    assert not {r.surrogate.lower() for r in made} & {r[1].lower() for r in rows}
    assert all(r.surrogate[:3] == r.real_value[:3] for r in made if len(r.real_value) == 6)


def test_values_of_a_full_format_take_no_further_cipher_steps(spark, key, monkeypatch):
    calls = []
    monkeypatch.setattr(asg, "fpe", lambda df, *names: calls.append(1) or fpe(df, *names))
    values = spark.createDataFrame([("PHONE_NUMBER", str(i), i) for i in range(10)], "entity_type string, real_value string, ord long")
    made = asg.assign(values, v.empty_vault(spark), policy_table(spark, default_policy(), key)).collect()
    assert len({r.surrogate for r in made}) == 10 and len(calls) <= 2


def test_a_settled_vault_is_not_grouped_again(spark):
    rows = [("PERSON", "Ann Lee", "Bea Roe", 0, False), ("PERSON", "Ann Lee", "Cid Poe", 1, False), ("LOCATION", "Rome", "Oslo", 2, False)]
    vault = spark.createDataFrame(rows, v.VAULT)
    held = v.settled(vault)
    assert v.forward(held) is held is v.settled(held)
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, v.forward(vault).collect())) == sorted(rows[1:])

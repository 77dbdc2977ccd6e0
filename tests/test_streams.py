import pytest

from maskloom.plans.mask import mask
from maskloom.policy import REPLACE, EntityRule, Policy, default_policy
from maskloom.sources.policy_store import PolicyStore
from maskloom.sources.vault_store import VaultStore
from maskloom.streaming import streams


def test_stream_batches_share_the_vault_and_replay(spark, key, tmp_path):
    rows = [(1, "write a@b.com"), (2, "or A@B.COM and c@d.org"), (3, "again a@b.com c@d.org")]
    store = VaultStore(spark, f"{tmp_path}/vault")
    policies = [default_policy(), default_policy(), Policy(entities={"EMAIL_ADDRESS": EntityRule(REPLACE)})]
    turn = iter(policies)
    run = streams.mask_batch(store, lambda: next(turn), key, ["id"], f"{tmp_path}/out")
    docs = spark.createDataFrame(rows, "id int, text string")
    run(docs.where("id = 1"), 0)
    run(docs.where("id > 1"), 1)
    out = {r.id: r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    whole = {r.id: r.text for r in mask(docs, ["id"], default_policy(), key).documents.collect()}
    assert out == whole
    before = {tuple(r) for r in store.read().collect()}
    run(docs.where("id > 1"), 1)  # the batch runs again, under a reloaded policy
    again = {r.id: r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert again[1] == out[1] and "<EMAIL_ADDRESS>" in again[2]
    assert {tuple(r) for r in store.read().collect()} <= before


def test_a_batch_keeps_its_policy_when_it_runs_again(spark, key, tmp_path):
    policies = PolicyStore(spark, f"{tmp_path}/policy")
    with pytest.raises(LookupError):
        policies.at(0)
    one = Policy(entities={"EMAIL_ADDRESS": EntityRule(REPLACE)}, never_mask_paths=("a.*",), notice=False)
    two = default_policy()
    assert [policies.publish(one), policies.publish(two, from_batch=3)] == [0, 1]
    assert policies.at(0) == policies.at(2) == one and policies.at(3) == policies.at(99) == two
    run = streams.mask_batch(VaultStore(spark, f"{tmp_path}/vault"), policies, key, ["id"], f"{tmp_path}/out")
    docs = spark.createDataFrame([(1, "to a@b.com")], "id int, text string")
    for batch in (0, 3, 0):
        run(docs, batch)
    out = {r.batch_id: r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out[0] == "to <EMAIL_ADDRESS>" and "<" not in out[3] and "a@b.com" not in out[3]


def test_writers_keep_apart_and_conflicts_are_found(spark, tmp_path):
    row = "entity_type string, real_value string, surrogate string, seq long, derived boolean"
    one, two = (VaultStore(spark, f"{tmp_path}/vault", writer=w) for w in ("one", "two"))
    one.write(0, spark.createDataFrame([("PERSON", "Ann Lee", "Q Z", 0, False)], row))
    two.write(0, spark.createDataFrame([("PERSON", "Bob Ray", "q z", 0, False), ("PERSON", "ann lee", "Q Z", 1, False)], row))
    assert one.read().count() == two.read().count() == 3
    assert one.read(before=0).count() == 2 and two.read(before=0).count() == 1
    assert [(r.surrogate, sorted(r.real_values)) for r in one.conflicts().collect()] == [("q z", ["ann lee", "bob ray"])]
    two.write(0, spark.createDataFrame([], row))  # the batch runs again
    assert one.read().count() == 1 and one.conflicts().count() == 0

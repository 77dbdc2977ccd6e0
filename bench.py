"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs over its whole tables and its result is counted. With BENCH_RUNS=2 the
second run is recorded, without the time the first one spends on compiling its plans.
"""

import json
import os
import sys
import time

from pyspark.sql import functions as F

from maskloom.operators import assign as asg, demask, detect, vault as v
from maskloom.plans import inputs
from maskloom.plans.catalog import CHECK_KEY
from maskloom.plans.mask import discover, mask
from maskloom.policy import default_policy, policy_table
from maskloom.runtime import materialize, session, spread

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def main() -> None:
    spark = session("bench", cores=os.environ.get("BENCH_CPUS", "8"), spark__driver__memory="20g")
    policy = default_policy()
    documents = inputs.load(spark, SF_DIR, "SELECT doc_id, text FROM documents")
    notes = inputs.load(spark, SF_DIR, inputs.NOTES).select("o_orderkey", "text")
    people_vault = materialize(inputs.load(spark, SF_DIR, inputs.VAULT))
    rules = policy_table(spark, policy, CHECK_KEY)
    fresh = inputs.load(
        spark,
        SF_DIR,
        f"""SELECT CASE o_orderkey % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'EMAIL_ADDRESS' ELSE 'CREDIT_CARD' END AS entity_type, o_orderkey AS ord,
            CASE o_orderkey % 3 WHEN 0 THEN full_name || {inputs._word('o_orderkey')} WHEN 1 THEN cast(o_orderkey as string) || email
                 ELSE lpad(cast(o_orderkey * 7919 as string), 16, '4') END AS real_value FROM ({inputs.NOTES}) n""",
    )

    def known():
        units = detect.pieces(detect.leaves(spread(notes), ["o_orderkey"]), ["o_orderkey"])
        return detect.known(units, ["o_orderkey"], policy, people_vault)

    masked = {}

    def mask_documents():
        masked["done"] = mask(documents, ["doc_id"], policy, CHECK_KEY)
        return masked["done"].documents.where(F.length("text") >= 0)

    def demask_documents():
        done = masked["done"]
        return demask.demask(done.documents.select("doc_id", "text"), ["doc_id"], done.vault).where(F.length("demasked") >= 0)

    queries = {
        "discover_documents": lambda: discover(spread(documents), ["doc_id"], policy),
        "mask_documents": mask_documents,
        "demask_documents": demask_documents,
        "known_value_join": known,
        "assign_new_values": lambda: asg.assign(fresh, v.empty_vault(spark), rules),
        "reverse_lookup": lambda: v.find_real_anywhere(people_vault.select("surrogate"), people_vault),
    }
    seconds = {}
    for name, make in queries.items():
        for _ in range(RUNS):
            start = time.time()
            make().count()
            seconds[name] = round(time.time() - start, 2)
            print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_time", "value": round(sum(seconds.values()), 2), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()

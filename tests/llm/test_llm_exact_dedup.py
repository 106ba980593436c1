import hashlib
import re
from collections import Counter, defaultdict

from llm_util import awkward, awkward_rows, empty

from tessera.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups[norm].append((-len(text or ""), doc is not None, doc or 0, doc))
    out = Counter()
    for norm, members in groups.items():
        members.sort()
        for nth, (_, _, _, doc) in enumerate(members):
            out[doc, members[0][3], len(members), nth == 0,
                hashlib.sha256(norm.encode()).hexdigest()] += 1
    return out


def test_marks_match_brute_force(spark):
    rows = awkward_rows()
    told = exact_dedup.mark(awkward(spark), prefix_chars=8, settle_hash=True).collect()
    assert Counter((r.key, r.keep_key, r.group_size, r.kept, r.full_hash) for r in told) == \
        brute(rows)


def test_full_hash_only_for_survivors(spark):
    told = {r.key: r for r in exact_dedup.refine(awkward(spark)).collect()}
    assert told[27].full_hash is None and not told[27].alive
    assert told[20].full_hash is not None and told[20].alive


def test_deduplicate_keeps_one_row_a_group_and_all_columns(spark):
    docs = awkward(spark)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    want = {re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in awkward_rows()}
    assert len(norm) == len(set(norm)) and set(norm) == want


def test_one_repeated_row_and_empty_table(spark):
    docs = awkward(spark, [(1, "a b", "en", "s", 1)] * 50)
    assert exact_dedup.deduplicate(docs).count() == 1
    told = exact_dedup.mark(docs).collect()
    assert sum(r.kept for r in told) == 1 and {r.group_size for r in told} == {50}
    assert exact_dedup.mark(empty(spark)).count() == 0
    assert exact_dedup.deduplicate(empty(spark)).count() == 0

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallymill.llm import chat, quality_rules as qr

from . import data


def measured(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    covered = {i + k for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_measures_match_python(spark):
    rng = random.Random(2)
    pairs = data.rows() + [(1000 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + "\n#$\n#$") for i in range(80)]
    pairs += [(2000, "one two three four five six seven eight nine " * 3), (2001, "w " * 9)]
    got = qr.ledger(data.frame(spark, pairs)).collect()
    want = Counter((i, *measured(t or "")) for i, t in pairs)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_policies_and_ablations(spark):
    rows = qr.ledger(data.frame(spark, data.rows()))
    got = {v: {(r.doc_id, r.fail_bits): r.kept for r in qr.apply_policy(rows, v).collect()} for v in qr.POLICIES}
    for v, mask in qr.POLICIES.items():
        assert all(kept == (bits & mask == 0) for (_, bits), kept in got[v].items())
    bits = [r.fail_bits & qr.POLICIES["v3"] for r in rows.collect()]
    for r in qr.ablations(rows, "v3").collect():
        b = qr.BIT[r.rule]
        assert (r.n_failed, r.n_only) == (sum(x & b > 0 for x in bits), sum(x == b for x in bits))
    assert qr.ledger(data.empty(spark)).count() == 0
    assert qr.ablations(qr.ledger(data.empty(spark))).count() == len(qr.RULES)


TURNS = "conv_id bigint, turn bigint, role string, text string, formatted string, turns int"


def test_chat_round_trip(spark):
    rng = random.Random(4)
    parts = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "\n", "assistant", "␛", "␛L|", "<", "|", "é", " hi ", "%", "\\"]
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "a\nb", "<|x", None])
            rows.append((c, t, role, rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))])))
    rows += [(50, 0, "user", "a"), (50, 0, "user", "a"), (50, None, "assistant", "first"), (None, 1, "user", "lost")]
    rows.append((60, 0, "assistant", "long " * 20000))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    out = chat.format_chats(df)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    want = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for r in sorted(rows, key=key):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss == "".join(x for role, x in turns if role == "assistant")
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        assert got[c].formatted.count("<|im_start|>") == blocks
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_query_has_the_added_conversation(spark, tmp_path):
    spark.createDataFrame([(3, 0, "user", "q"), (3, 1, "assistant", None)], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op8_chat_format(spark, str(tmp_path)).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    assert set(got) == {-1, 3}
    assert got[-1].loss_chars == len(said)
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_a_stored_ledger_is_read_and_ruled_on_later(spark, tmp_path):
    rows = qr.ledger(data.frame(spark, data.rows()))
    qr.write_ledger(rows, f"{tmp_path}/a")
    again = qr.read_ledger(spark, f"{tmp_path}/a")
    for version in qr.POLICIES:
        one, two = (Counter((r.doc_id, r.fail_bits, r.kept) for r in qr.apply_policy(x, version).collect()) for x in (rows, again))
        assert one == two
    assert qr.ablations(again).collect() == qr.ablations(rows).collect()
    spark.createDataFrame([("other", 1, "n_words < 3")], "rule string, bit long, fails string").write.mode("overwrite").parquet(f"{tmp_path}/a/rules")
    with pytest.raises(ValueError):
        qr.read_ledger(spark, f"{tmp_path}/a")

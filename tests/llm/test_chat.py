import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from triledger.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations():
    rng = random.Random(1)
    pieces = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "<", "s>", "[", " ", "  \n", "é🙂", "hello", "<\\s>", "/INST]", "'s", ""]
    out = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "<s>tool"]), "".join(rng.choice(pieces) for _ in range(rng.randrange(12))))
           for c in range(40) for t in range(rng.randrange(1, 9))]
    return out + [(None, 0, "assistant", "no id"), (50, 0, None, None), (51, None, "assistant", None), (51, 1, "assistant", ""),
                  (52, 0, "user", "tie b"), (52, 0, "user", "tie a"), (53, 0, "assistant", "twice"), (53, 0, "assistant", "twice"),
                  (54, 0, "assistant", "long " * 30_000)]


def brute(turns):
    out, convs = [], defaultdict(list)
    for c, t, role, text in turns:
        convs[c].append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    for c, rows in convs.items():
        rows.sort()
        said = [(r[3], r[5]) for r in rows]
        loss = "".join(t for r, t in said if r == "assistant")
        out.append((c, len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part", [5, chat.PART])
def test_turns_and_loss_are_read_back(spark, part):
    frame = spark.createDataFrame(conversations(), SCHEMA).withColumns({"part": F.lit("own"), "ids": F.lit(1)}).repartition(4)
    formatted = chat.format_conversations(frame, part=part)
    got = sorted((tuple(r)[:5] for r in chat.read_back(formatted).collect()), key=repr)
    assert got == brute(conversations())


def test_parts_have_the_tokens_of_the_whole(spark):
    frame = spark.createDataFrame(conversations(), SCHEMA)

    def joined(rows):
        ids, mask = defaultdict(list), defaultdict(list)
        for r in sorted(rows, key=lambda r: r["part"]):
            ids[r["conv_id"]] += r["ids"]
            mask[r["conv_id"]] += r["loss_mask"]
        return ids, mask

    assert joined(chat.format_conversations(frame, part=5).collect()) == joined(chat.format_conversations(frame).collect())


def test_no_token_reaches_across_a_turn():
    text, begins, ends = chat.render([("user", " a"), ("assistant", "  b\n"), ("assistant", "")])
    ids, mask = chat.masked(text, begins, ends, chat.VOCABULARY)
    known = chat.tokenizer(chat.VOCABULARY)
    assert known.decode([int(i) for i, m in zip(ids, mask, strict=True) if m], skip_special_tokens=False) == "  b\n"


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "\\", "a\\", "<\\s>", "<s", "\\\\<s>", "[[INST]]"])
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROL)


def test_no_turns(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0

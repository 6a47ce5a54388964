import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import chat
from millrace.operators.bpe_codec import Tokenizer
from millrace.operators.bpe_train import train_bpe, word_counts
from millrace.plans.chat import convert_to_chatml, read_chat, tokenise_chat
from millrace.sources.readers import parse_objects

U, A = {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}
QA = [("user", "q"), ("assistant", "a")]

ROWS = [
    ({"messages": [U, A]}, QA),
    ({"messages": [{"role": " Human\t", "content": " q "}, {"role": "GPT", "content": "a\n"}]}, QA),
    ({"messages": [{"role": "prompter", "content": "q"}, {"role": "Bot", "content": "a"}, {"role": "SYSTEM", "content": "s"}]}, [*QA, ("system", "s")]),
    ({"messages": [{"role": "model", "content": "a"}]}, [("assistant", "a")]),
    ({"messages": [{"role": "tool", "content": "x"}, A]}, None),
    ({"messages": [{"role": "", "from": "human", "content": "", "value": "q"}, {"from": "gpt", "value": "a"}]}, QA),
    ({"messages": [{"role": None, "from": "human", "content": [], "value": "q"}, {"role": 0, "from": "gpt", "content": False, "value": "a"}]}, QA),
    ({"messages": [{"role": {}, "from": "human", "content": 0.0, "value": "q"}, A]}, QA),
    ({"messages": [{"role": 5, "from": "human", "content": "q"}, A]}, None),
    ({"messages": [{"role": "user", "content": "  ", "value": "q"}, A]}, None),
    ({"messages": []}, None),
    ({"messages": [U]}, None),
    ({"messages": "text"}, None),
    ({"messages": [U, "text", A]}, None),
    ({"messages": [U, {"role": "user", "content": None}], "conversations": [U, A]}, QA),
    ({"messages": None, "conversation": [U, A]}, QA),
    ({"messages": [{"role": "bad", "content": "x"}], "prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    ({"messages": [{"role": "user", "content": [" q ", {"type": "text", "text": "two"}, {"content": "three"}, {"text": "", "content": "four"}, 7, " "]}, A]}, [("user", "q\ntwo\nthree\nfour"), ("assistant", "a")]),
    ({"messages": [{"role": "user", "content": [{"text": 5, "content": "hidden"}]}, A]}, None),
    ({"messages": [{"role": "user", "content": {"text": "q"}}, A]}, None),
    ({"prompt": " p ", "response": " r "}, [("user", "p"), ("assistant", "r")]),
    ({"prompt": "  ", "question": "p", "query": "no", "answer": "r", "chosen": "no"}, [("user", "p"), ("assistant", "r")]),
    ({"instruction": "p", "input": " more ", "output": "r"}, [("user", "p\n\nmore"), ("assistant", "r")]),
    ({"instruction": "p", "input": 3, "completion": "r"}, [("user", "p"), ("assistant", "r")]),
    ({"prompt": 3, "response": "r"}, None),
    ({"prompt": "p"}, None),
    ({}, None),
]


def frame(spark, rows):
    return parse_objects(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "ord bigint, line string"))


def test_every_schema(spark):
    found = chat.convert_chat(frame(spark, [r for r, _ in ROWS])).orderBy("ord").collect()
    for (row, expected), got in zip(ROWS, found):
        messages = None if got.messages is None else [(m.role, m.content) for m in got.messages]
        assert messages == expected, row
        rendered = None if expected is None else "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in expected)
        assert got.text == rendered


def test_passed_fields_keep_their_type(spark):
    rows = [
        {"messages": [U, A], "dataset": "d", "source": 5, "prompt_id": {"a": [1]}, "category": None},
        {"messages": [U, A], "dataset": 7, "source": "", "prompt_id": False},
    ]
    as_json = lambda df: [json.loads(r[0]) for r in df.orderBy("ord").select(F.to_json(F.struct(*[c for c in df.columns if c != "ord"]))).collect()]
    plain = as_json(chat.convert_chat(frame(spark, rows)))
    assert {k: v for k, v in plain[0].items() if k not in ("text", "messages")} == {"dataset": "d", "source": 5, "prompt_id": {"a": [1]}}
    assert {k: v for k, v in plain[1].items() if k not in ("text", "messages")} == {"source": "", "prompt_id": False}
    assert [r["dataset"] for r in as_json(chat.convert_chat(frame(spark, rows), "", "named"))] == ["named", "named"]


@pytest.mark.parametrize("limit,seen,written", [(None, 27, 17), (0, 1, 1), (3, 3, 3), (5, 6, 5), (99, 27, 17)])
def test_limit_and_summary(spark, tmp_path, limit, seen, written):
    out = str(tmp_path / "chat")
    summary = convert_to_chatml(frame(spark, [r for r, _ in ROWS]), out, max_examples=limit).first()
    expected_written = sum(e is not None for _, e in ROWS) if written == 17 else written
    assert (summary.rows_seen, summary.rows_written, summary.rows_skipped) == (seen, expected_written, seen - expected_written)
    lines = spark.read.text(out).collect()
    assert len(lines) == expected_written
    with pytest.raises(FileExistsError):
        convert_to_chatml(frame(spark, [r for r, _ in ROWS]), out)


def test_columns_convert_like_json(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [("p1", "r1", None), ("p2", " ", "c"), ("p3", "r3", "c")]
    spark.createDataFrame(rows, "instruction string, output string, category string").coalesce(1).write.parquet(path)
    got = chat.convert_chat(read_chat(spark, "parquet", path)).orderBy("ord").collect()
    assert [r.messages and r.messages[0].content for r in got] == ["p1", None, "p3"]
    with pytest.raises(ValueError):
        read_chat(spark, "text", path)


def test_labels_mask_all_but_assistant_content_and_suffix(spark, tmp_path):
    texts = spark.createDataFrame([(0, "the answer is here. the end."), (1, "hi.<|im_end|>\n" * 4)], "ord bigint, text string")
    coder = Tokenizer(train_bpe(word_counts(texts), 257 + 30))
    encode = {}
    pieces = ["<|im_start|>user\n", "<|im_start|>assistant\n", "<|im_start|>system\n", "<|im_end|>\n", "q", "hi.", "the end."]
    for text, ids in spark.createDataFrame([(p,) for p in pieces], "t string").select("t", coder.encode(F.col("t"))).collect():
        encode[text] = ids
    conversations = [[("system", "q"), ("user", " hi. "), ("assistant", "the end.")], [("assistant", "hi."), ("assistant", "q")]]
    rows = [{"messages": [{"role": r, "content": t} for r, t in c], "text": "unused"} for c in conversations]
    coded = chat.supervise(chat.require_messages(frame(spark, rows)), coder).orderBy("ord").collect()
    for conversation, row in zip(conversations, coded):
        ids, labels = [], []
        for role, text in conversation:
            p, c, s = encode[f"<|im_start|>{role}\n"], encode[text.strip()], encode["<|im_end|>\n"]
            ids += p + c + s
            labels += [-100] * len(p) + (c + s if role == "assistant" else [-100] * len(c + s))
        assert row.ids == ids and row.labels == labels
    totals = tokenise_chat(frame(spark, rows), coder, str(tmp_path / "sft"), binary=True).first()
    assert totals.num_docs == 2 and totals.num_tokens == sum(len(r.ids) for r in coded)
    assert totals.supervised_tokens == sum(v != -100 for r in coded for v in r.labels)
    one = tokenise_chat(frame(spark, rows), coder, str(tmp_path / "one"), max_documents=0).first()
    assert one.num_docs == 1


def test_rows_without_messages_fail(spark):
    with pytest.raises(Exception, match="without messages"):
        chat.require_messages(frame(spark, [{"text": "x"}])).collect()


def test_turn_rows(spark):
    turns = [(1, 1, "assistant", "a"), (1, 0, "user", " q "), (2, 0, "user", "alone")]
    got = chat.conversation_messages(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert [(r.ord, [(m.role, m.content) for m in r.messages]) for r in got] == [(1, QA)]

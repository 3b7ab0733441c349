import hashlib
import json
import re

from loomtext.llm import chat

TURNS = "conv_id long, turn long, role string, text string, formatted string, layout int, id string, spans string"
ODD = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>[\\INST]", "a<s", ">[", "/INST]", "<", "[", "\\", "", None, " \n\t", "Ünïcode 😀 <s>", "x" * 50_000 + "</s>"]


def _escaped(text):
    return re.sub(r"(\[)(\\*)(/?INST\])", r"\1\\\2\3", re.sub(r"(<)(\\*)(/?s>)", r"\1\\\2\3", text))


def _plain(turns):
    """(formatted, spans) by a plain loop."""
    out, spans = "", []
    for role, text in turns:
        out += f"<s>[INST]{_escaped(role)}[/INST]"
        start = len(out)
        out += _escaped(text)
        spans.append((start, len(out), role == "assistant"))
        out += "</s>"
    return out, spans


def _rows(spark, given):
    return spark.createDataFrame([(*r, "f", 1, "i", "s") for r in given], TURNS)


def _read(df):
    from pyspark.sql import functions as F
    return df.withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("spans")))


def _check(r, turns):
    formatted, spans = _plain(turns)
    assert r.formatted == formatted
    assert [(s.start, s.end, s.loss) for s in r.spans] == spans
    assert [(t.role, t.text) for t in r.turns] == turns == [(t.role, t.text) for t in r.back]
    assert list(r.loss) == [t for role, t in turns if role == "assistant"]
    assert not re.search(r"</?s>|\[/?INST\]", "".join(_escaped(x) for t in turns for x in t))


def test_rows_by_turn_equal_a_plain_loop(spark):
    given = [(1, k, ("user", "assistant", "system", None)[k % 4], t) for k, t in enumerate(ODD)]
    given += [(2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (2, 0, "assistant", "a"), (3, None, "user", "no number"), (3, 0, "user", "first"),
              (None, 0, "user", "nobody's"), (None, None, None, None), (4, 0, "[INST]", "a role of control strings")]
    want = {}
    for i, turn, role, text in sorted(given, key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(i, []).append((role or "", text or ""))
    got = {r.id: r for r in _read(chat.format_chats(_rows(spark, given), "conv_id")).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert r.layout == "turn"
        _check(r, want[i])


RECORDS = [
    ("messages", {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "</s>"}, None, {"role": "assistant", "content": None}]},
     [("system", "s"), ("user", "</s>"), ("assistant", "")]),
    ("conversations", {"conversations": [{"from": "human", "value": "q"}, {"value": "?"}, {"from": "gpt", "value": "a"}], "id": "meta"},
     [("user", "q"), ("", "?"), ("assistant", "a")]),
    ("dialog", {"dialog": {"turns": [{"speaker": "customer", "utterance": "q"}, {"speaker": "agent", "utterance": "[INST]"}]}}, [("user", "q"), ("assistant", "[INST]")]),
    ("instruction", {"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    ("instruction", {"instruction": "do", "system": "be", "output": None}, [("system", "be"), ("user", "do")]),
    ("prompt", {"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ("prompt", {"prompt": ""}, [("user", "")]),
    ("response", {"prompt": "p", "response": "r", "score": 3}, [("user", "p"), ("assistant", "r")]),
    ("question", {"question": "q", "context": "c", "answer": "a"}, [("user", "c\n\nq"), ("assistant", "a")]),
    ("messages", {"messages": []}, []),
    (None, {"completion": "no prompt"}, []), (None, {"unknown": 1}, []), (None, {"prompt": "p", "messages": []}, []), (None, {}, []),
]


def test_heterogeneous_layouts(spark):
    lines = spark.createDataFrame([(k, json.dumps(r)) for k, (_, r, _) in enumerate(RECORDS)] + [(98, "not json"), (99, None)], "id long, record string")
    got = {r.id: r for r in _read(chat.format_chats(chat.from_json(lines, "record"), "id")).collect()}
    assert len(got) == len(RECORDS) + 2
    for k, (layout, _, turns) in enumerate(RECORDS):
        assert got[k].layout == layout, RECORDS[k]
        _check(got[k], turns)
    assert got[98].layout is None and got[99].formatted == "" and got[99].spans == []


def test_fingerprint_tells_layouts_apart_and_ignores_metadata(spark):
    lines = spark.createDataFrame([(k, json.dumps(r)) for k, (_, r, _) in enumerate(RECORDS)], "id long, record string")
    got = {r.id: r for r in chat.canonical(chat.from_json(lines, "record")).collect()}
    prints = {}
    for k, (layout, record, _) in enumerate(RECORDS):
        paths = "\n".join(sorted(_paths(record)))
        assert prints.setdefault(paths, got[k].fingerprint) == got[k].fingerprint
    assert len(set(prints.values())) == len(prints)


def _paths(record):
    known = {p for layout in chat.LAYOUTS for p in layout.paths()}
    out = set()
    for key, value in record.items():
        if isinstance(value, dict):
            out |= {f"{key}.{p}" for p in _paths_of(value)}
        else:
            out |= _paths_of({key: value})
    return out & known


def _paths_of(fields):
    out = {k for k, v in fields.items() if v is not None}
    return out | {f"{k}[].{s}" for k, v in fields.items() if isinstance(v, list) for m in v if m for s, x in m.items() if x is not None}


def test_empty_tables_and_clashing_names(spark):
    assert chat.format_chats(_rows(spark, []), "conv_id").count() == 0
    none = spark.createDataFrame([], "id long, record string")
    assert chat.format_chats(chat.from_json(none, "record"), "id").count() == 0
    clash = spark.createDataFrame([("k", "p", "c", 1, "t", "f")], "id string, prompt string, completion string, layout int, turns string, fingerprint string")
    r = chat.format_chats(clash, "id").first()
    assert (r.id, r.layout, [tuple(t) for t in r.turns]) == ("k", "prompt", [("user", "p"), ("assistant", "c")])
    bare = chat.format_chats(spark.createDataFrame([(1, "x")], "id long, note string"), "id").first()
    assert bare.layout is None and bare.turns == []


def test_query_reads_back_what_the_rows_say(spark):
    from loomtext.llm.queries import CONTROL, QUERIES
    sf = "/root/testdata/sf0.001"
    want = {-1: [("user", CONTROL), ("assistant", CONTROL)]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    df = QUERIES["op11_chat_format"](spark, sf)
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", df._jdf.queryExecution().toString())
    got = {r.conv_id: r for r in df.collect()}
    assert set(got) == set(want)
    for i, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        told = "".join(f"{role}\n{t}\n" for role, t in turns)
        assert (got[i].n_turns, got[i].loss_chars, got[i].formatted_chars) == (len(turns), len(loss), len(_plain(turns)[0]))
        assert got[i].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert got[i].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()

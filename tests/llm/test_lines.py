from collections import Counter, defaultdict

from pyspark.sql import functions as F

from loomtext.llm import common as C
from loomtext.llm import line_dedup
from helpers import docs, odd_texts, words


def _plain(given, ratio, least):
    pages = {(s, t or "") for _, t, _, s in given}
    total, seen = Counter(s for s, _ in pages), defaultdict(int)
    for s, t in pages:
        for line in {x for x in t.split("\n") if words(x)}:
            seen[s, line] += 1
    drop = {k for k, n in seen.items() if n >= least and n > ratio * total[k[0]]}
    out = []
    for i, t, _, s in given:
        lines = (t or "").split("\n")
        kept = [x for x in lines if (s, x) not in drop]
        out.append((i, sum(bool(words(x)) for x in lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def _given():
    out = odd_texts()
    for i in range(200, 240):
        out.append((i, f"own line {i}\nCookie notice\n\nshared by {i % 4}\nCookie notice", "en", "s1" if i % 3 else None))
    out += [(250, "page of four rows\nits second line", "en", "s2")] * 4 + [(None, "page of null ids\nits second line, too", "en", "s2")] * 5
    out += [(260, f"one id, text {i}\nand a line of all its texts", "en", "s9") for i in range(4)]
    return out + [(300 + i, "a copied page\nof two lines", "en", "s2") for i in range(30)]


def _run(df, **kind):
    out = line_dedup.drop_boilerplate(df, "doc_id", F.col("source"), 0.05, 3)
    return sorted(((r.row.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=repr)


def test_equals_plain_version(spark):
    want = _plain(_given(), 0.05, 3)
    assert _run(docs(spark, _given())) == want
    assert sum(w[2] for w in want) >= 80
    copied = [w for w in want if w[0] is not None and 300 <= w[0] < 330]
    assert all(w[2] == 0 for w in copied)  # copies of one page are one page
    assert [w[2] for w in want if w[0] in (250, None) and "page of" in w[3]] == [0] * 9  # so are repeated rows
    assert [w[2] for w in want if w[0] == 260] == [1] * 4  # rows of one id with different texts are not


def test_salted_form_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    assert _run(docs(spark, _given())) == _plain(_given(), 0.05, 3)


def test_empty_table_and_columns(spark):
    assert _run(docs(spark, [])) == []
    out = line_dedup.drop_boilerplate(docs(spark, odd_texts()), "doc_id", F.col("source"))
    assert out.select("row.*").columns == docs(spark, []).columns


def test_visible_lines_of_pages(spark):
    html = "<html><head><title>T</title><style>p{}</style></head><body><!-- x --><p>One <b>two</b></p>\n <div>three<br/>four</div><script>a()</script></body>"
    rows = [(1, "https://a.Example.com:80/x?y", html), (2, None, None), (3, "no url", "")]
    got = {r.page_id: (r.host, r.text) for r in line_dedup.page_lines(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1][0] == "a.example.com:80"
    assert [x for x in got[1][1].split("\n") if x] == ["T", "One two", "three", "four"]
    assert got[3] == ("", "") and got[2] == (None, "")

"""Personal data, urls, chat and the pipeline."""

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, pii, url_trust
from millrace.llm.queries import QUERIES, URL_RULES

SF_DIR = "/root/testdata/sf0.001"
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute_spans(text):
    found = []
    for kind, (name, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text, re.A):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if name == "card" and not (16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if name == "phone" and not 8 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return found


@pytest.mark.parametrize(
    "text",
    ["a@b.c x@y d@e.f.", "@@a@b.c@d.e", "1.2.3.4.5.6.7.8.9 256.1.1.1 01.002.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+49 (30) 123-4567 + 1 +1", "", "é a@b.c 😀 1.1.1.1"],
)
def test_base_spans_equal_plain_patterns(text):
    assert sorted(pii.base_spans(text)) == brute_spans(text)


def test_base_spans_on_all_documents(spark):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert all(sorted(pii.base_spans(t)) == brute_spans(t) for t in texts)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("write to jane dot doe at example dot org now", "email", "jane dot doe at example dot org"),
        ("write to jane [at] example [dot] org now", "email", "jane [at] example [dot] org"),
        ("write jаne@exаmple.org now", "email", "jаne@exаmple.org"),
        ("call +four nine three zero one two three four five six now", "phone", "+four nine three zero one two three four five six"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, part):
    spans = pii.find_personal_data(text)[1]
    assert (kind, part) in [(pii.KINDS[k], text[a:b]) for k, a, b in spans]


@pytest.mark.parametrize("at", [" @ ", "@ ", " @", " at ", "[at]", " (at) ", "<@>", "{ @ }"])
@pytest.mark.parametrize("dot", [".", " dot ", "[dot]", " (.) ", " punkt "])
def test_each_address_form_is_found_alone(at, dot):
    part = f"john{at}example{dot}com"
    text = f"mail {part} now"
    found = [(pii.KINDS[k], text[a:b]) for k, a, b in pii.find_personal_data(text)[1]]
    assert found == ([] if (at, dot) == (" at ", ".") else [("email", part)])


@pytest.mark.parametrize(
    ("kind", "part"),
    [
        ("phone", "plus four nine 1 5 1 2 3 4 5 6 7 8"),
        ("phone", "+4 9 1 5 one 2 3 4 5 6"),
        ("ip", "one two seven dot zero dot zero dot one"),
        ("ip", "one two seven (dot) zero [.] zero punkt eins"),
        ("ip", "192 dot 168 dot one dot 1"),
        ("ip", "zero dot 168 dot one dot 1"),
        ("card", "four 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"),
    ],
)
def test_any_digit_word_and_dot_words_join_a_run(kind, part):
    text = f"it is {part} now"
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in pii.find_personal_data(text)[1]] == [(kind, part)]


@pytest.mark.parametrize("text", ["one point five of seven dot nine", "one. two. three, four", "plus one two", "three hundred dot nine zero zero dot one dot one", "two dot five six seven dot one dot one"])
def test_spelled_runs_that_no_detector_takes_are_left_alone(text):
    assert pii.find_personal_data(text)[1] == []


def test_prose_is_left_alone():
    assert pii.find_personal_data("look at example.com, one two three, at nine dot")[1] == []


def test_masking_keeps_rows_and_counts(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd now", 15), (2, None, None), (3, "", 0)], "doc_id long, text string, n_chars long")
    rows = {r["doc_id"]: r for r in pii.mask_personal_data(docs).collect()}
    assert rows[1]["text"] == "mail [EMAIL] now" and rows[1]["n_chars"] == 16 and rows[2]["text"] is None and len(rows) == 3
    assert pii.personal_data(docs.where("false")).count() == 0


def brute_rank(seed, edges, damping=0.85):
    out, rank = {}, dict(seed)
    for (src, _), n in edges.items():
        out[src] = out.get(src, 0) + n
    linked = {dst for _, dst in edges}
    for _ in range(30):
        now = {}
        for h in seed:
            flow = sum(n / out[s] * rank[s] for (s, d), n in edges.items() if d == h)
            now[h] = (1 - damping) * seed[h] + damping * flow if h in linked else seed[h]
        step, rank = max(abs(now[h] - rank[h]) for h in seed), now
        if step <= 1e-6:
            break
    return rank


def test_rank_equals_brute_force(spark):
    edges = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 3, ("c", "a"): 1, ("d", "c"): 1}
    seed = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.5, "e": 0.25}
    found = url_trust.personalised_rank(
        spark.createDataFrame(list(seed.items()), "host string, seed double"), spark.createDataFrame([(s, d, n) for (s, d), n in edges.items()], "src string, dst string, links long")
    )
    assert {r["host"]: r["rank"] for r in found.collect()} == pytest.approx(brute_rank(seed, edges), abs=1e-9)


def test_rules_and_hosts(spark):
    urls = [
        ("http://Sub.Example.NET/en/x?q", "sub.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("https://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
        ("http://example.com/de/a#f", "example.com", "/de/a", "example.com/de/", "block"),
        ("http://notnet/", "notnet", "/", None, "allow"),
        ("http://a.net", "a.net", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, u[0], None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in url_trust.judge_urls(pages, URL_RULES).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(urls):
        assert (rows[k]["host"], rows[k]["path"], rows[k]["rule"], rows[k]["verdict"]) == (host, path, rule, verdict)
    assert url_trust.judge_urls(pages.where("false"), URL_RULES).count() == 0


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    html = '<a href="http://bad.net/1">x</a><a href="http://bad.net/2">y</a>'
    pages = spark.createDataFrame([(1, "http://farm.io/", html), (2, "http://bad.net/", None), (3, "http://fine.io/", None)], "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_trust.judge_urls(pages, URL_RULES).collect()} == {1: "block", 2: "block", 3: "allow"}


@pytest.mark.parametrize("linkers", [2, 10])
def test_distrust_reaches_each_of_several_linkers(spark, linkers):
    html = '<a href="http://bad.net/1">x</a>'
    urls = [("http://bad.net/", None), ("http://fine.io/", None), *[(f"http://farm{k}.io/", html) for k in range(linkers)]]
    pages = spark.createDataFrame([(k, *u) for k, u in enumerate(urls)], "page_id long, url string, html string")
    found = [r["verdict"] for r in url_trust.judge_urls(pages, URL_RULES).orderBy("page_id").collect()]
    assert found == ["block", "allow", *["block"] * linkers]


def test_a_link_to_a_clean_host_does_not_weaken_the_own_seed(spark):
    html = '<a href="http://fine.io/">x</a>'
    pages = spark.createDataFrame(
        [(1, "http://example.com/de/a", html), (2, "http://example.com/de/b", None), (3, "http://example.com/de/c", None), (4, "http://example.com/x", None), (5, "http://fine.io/", None)],
        "page_id long, url string, html string",
    )
    rows = {r["page_id"]: r for r in url_trust.judge_urls(pages, URL_RULES).collect()}
    assert [rows[k]["verdict"] for k in range(1, 6)] == ["block"] * 4 + ["allow"]
    alone = {r["page_id"]: r for r in url_trust.judge_urls(pages.withColumn("html", F.lit(None).cast("string")), URL_RULES).collect()}
    assert rows[4]["distrust"] == pytest.approx(alone[4]["distrust"])


def test_rank_settles_relative_to_itself(spark):
    edges = {(a, b): 1 for a, b in ["ab", "ba", "bc", "cd"]}
    seed = {"a": 1e-9, "b": 0.0, "c": 0.0, "d": 0.0, "e": 0.5}
    found = url_trust.personalised_rank(
        spark.createDataFrame(list(seed.items()), "host string, seed double"), spark.createDataFrame([(s, d, n) for (s, d), n in edges.items()], "src string, dst string, links long"), settle=True
    )
    a = 0.15e-9 / (1 - 0.85**2 / 2)
    want = {"a": a, "b": 0.85 * a, "c": 0.85**2 * a / 2, "d": 0.85**3 * a / 2, "e": 0.075}
    assert {r["host"]: r["rank"] for r in found.collect()} == pytest.approx(want, rel=1e-5, abs=0)


def judged(spark, pages):
    table = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r for r in url_trust.judge_urls(table, URL_RULES).collect()}


def anchors(*hosts):
    return " ".join(f'<a href="http://{h}/">x</a>' for h in hosts)


def brute_verdicts(pages):
    """verdict, trust and distrust per page by plain loops; 400 rounds from zero."""
    seen, links, shares = [], {}, {}
    for url, html in pages:
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1].lower(), found[2]) if found else ("", "")
        fits = [(len(h + p), v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        seen.append((host, max(fits)[1] if fits else None))
        for to in re.findall(r'href="http://([^/"]*)/', html or ""):
            if to != host:
                links.setdefault(host, []).append(to)
    hosts = {h for h, _ in seen} | {t for to in links.values() for t in to}
    for h in hosts:
        verdicts = [v for at, v in seen if at == h]
        shares[h] = [verdicts.count(v) / max(1, len(verdicts)) for v in ("allow", "block")]
    trust, distrust = dict.fromkeys(hosts, 0.0), dict.fromkeys(hosts, 0.0)
    for _ in range(400):
        flow = dict.fromkeys(hosts, 0.0)
        for h, to in links.items():
            for t in to:
                flow[t] += trust[h] / len(to)
        trust = {h: shares[h][0] + 0.85 * flow[h] for h in hosts}
        mean = {h: sum(distrust[t] for t in links[h]) / len(links[h]) if h in links else 0.0 for h in hosts}
        distrust = {h: shares[h][1] + 0.85 * (1 - shares[h][1]) * mean[h] for h in hosts}
    bad = {h for h in hosts if distrust[h] >= 0.5 and distrust[h] > trust[h]}
    return [(v or ("block" if h in bad else "allow"), trust[h], distrust[h]) for h, v in seen]


@pytest.mark.parametrize("seed", [1])
def test_verdicts_equal_brute_force(spark, seed):
    dice = random.Random(seed)
    names = ["a.net", "b.example.net", "example.com", "x.org", "y.org", *(f"h{k}.io" for k in range(14))]
    pages = [(None, None), ("no scheme", anchors("a.net"))]
    for _ in range(90):
        host = dice.choice(names)
        pages.append((f"http://{host}/{dice.choice(['en/', 'de/', 'fr/', ''])}p", anchors(*dice.choices(names[:4] + names[dice.randrange(14):], k=dice.randrange(4)))))
    rows = judged(spark, pages + pages[:5])
    want = brute_verdicts(pages + pages[:5])
    assert [rows[k]["verdict"] for k in range(len(want))] == [w[0] for w in want] and len({w[0] for w in want}) == 2
    for column, place in (("trust", 1), ("distrust", 2)):
        assert [rows[k][column] for k in range(len(want))] == pytest.approx([w[place] for w in want], abs=1e-4)


def test_one_bad_link_among_many_good_ones_is_allowed(spark):
    pages = [("http://hub.io/", anchors("bad.net", *(f"good{k}.io" for k in range(60)))), ("http://fan.io/", anchors("hub.io")), ("http://bad.net/", None)]
    rows = judged(spark, pages)
    assert [rows[k]["verdict"] for k in range(3)] == ["allow", "allow", "block"]
    assert rows[0]["distrust"] == pytest.approx(0.85 / 61, abs=1e-6)


def test_few_blocked_pages_among_many_leave_the_host_alone(spark):
    pages = [("http://blog.example.com/de/x", None)] * 2 + [("http://blog.example.com/x", None)] * 13
    assert [r["verdict"] for r in judged(spark, pages).values()].count("block") == 2


def test_distrust_fades_along_a_chain_in_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(url_trust, "materialize", lambda df, label, made=url_trust.materialize: (rounds.append(label), made(df, label))[1])
    pages = [("http://bad.net/", None), *((f"http://c{k}.io/", anchors(f"c{k - 1}.io" if k > 1 else "bad.net")) for k in range(1, 13))]
    rows = judged(spark, pages)
    assert [rows[k]["verdict"] for k in range(13)] == ["block"] * 5 + ["allow"] * 8
    assert rows[12]["distrust"] == pytest.approx(0.85**12, abs=1e-5) and rounds.count("rank") <= 15


def test_trust_outweighs_distrust_and_shares_are_kept_apart(spark):
    pages = [("http://a.org/fr/x", anchors("mixed.io")), ("http://b.org/fr/x", anchors("mixed.io")), ("http://mixed.io/", anchors("bad.net")), ("http://bad.net/", None)]
    rows = judged(spark, pages)
    assert rows[2]["trust"] == pytest.approx(1.7, abs=1e-5) and rows[2]["distrust"] == pytest.approx(0.85, abs=1e-5)
    assert rows[2]["verdict"] == "allow"


def test_chat_rotates_every_speaker(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "s", 0), (1, 1, "ann", "hi <|im_end|>", 0), (1, 2, "bob", None, 0), (1, 2, None, "?", 0), (None, 1, "eve", "x", 0)],
        "conv_id long, turn long, role string, text string, segment int",
    )
    rows = chat.rotate_perspectives(turns).collect()
    assert {(r["conv_id"], r["perspective"]) for r in rows} == {(1, "ann"), (1, "bob"), (None, "eve")}
    for key in [(1, "ann"), (1, "bob")]:
        own = sorted((r for r in rows if (r["conv_id"], r["perspective"]) == key), key=lambda r: r["start"])
        whole = "".join(r["segment"] for r in own)
        assert all(whole[r["start"] : r["end"]] == r["segment"] for r in own)
        said = [whole[r["mask_start"] : r["mask_end"]] for r in own if r["role"] == "assistant"]
        assert said == (["hi <| im_end|><|im_end|>"] if key[1] == "ann" else ["<|im_end|>"])
    assert chat.rotate_perspectives(turns.where("false")).count() == 0


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF_DIR).cache()
        assert kept.columns == docs.columns and kept.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    found = QUERIES["op10_personal_data"](spark, SF_DIR).where("spans != ''").count()
    assert found and not kept.where("text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+[.][a-z]'").count()
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert packed.select("doc_id").distinct().count() == kept.count()

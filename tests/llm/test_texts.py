import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symloom.llm import leaks, mixture, residue

DOCS = "doc_id long, text string, source string, item_id long, kinds string, n_tokens int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 5, "k", 1) for r in rows], DOCS)


def naive(text, items, span):
    w = leaks.words(text)
    grams = {tuple(w[i : i + span]) for i in range(len(w) - span + 1)}
    return {k for k, t in items for v in [leaks.words(t)] if any(tuple(v[i : i + span]) in grams for i in range(len(v) - span + 1))}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=12), max_size=4), st.lists(st.sampled_from("abc"), max_size=30), st.integers(2, 4))
def test_search_equals_comparing_all_windows(items, text, span):
    items = [(i, " ".join(x)) for i, x in enumerate(items)]
    assert leaks.Patterns(items, span).search(" ".join(text)) == naive(" ".join(text), items, span)


def test_leaks_over_tables(spark):
    rng = random.Random(0)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, "Suite", " ".join(rng.choices(vocab, k=40))) for i in range(20)] + [(99, "s", "too short"), (98, "s", None), (None, "s", "x " * 20)]
    texts = []
    for d in range(60):
        w = rng.choices(vocab, k=30)
        if d % 3 == 0:
            _, _, t = items[rng.randrange(20)]
            v = t.upper().split()
            k = rng.choice([11, 12, 20])
            a = rng.randrange(len(v) - k)
            w[10:10] = [x + rng.choice(["", ",", " _ ", "\n> "]) for x in v[a : a + k]]
        texts.append((d, " ".join(w), "s"))
    texts += [(100, None, None), (101, "", ""), (None, texts[0][1], ""), texts[0], (102, texts[0][1] * 2000, "long")]
    I = spark.createDataFrame([(*x, 3) for x in items], "item_id long, suite string, text string, doc_id int")
    want = {(d, i) for d, t, _ in texts if d is not None and t for i in naive(t, [(k, x) for k, _, x in items if k is not None and x], 12)}
    assert want
    for block in (4_000_000, 800):
        got = [tuple(r) for r in leaks.leaks(docs(spark, texts), I, block_chars=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert leaks.leaks(docs(spark, []), I).collect() == [] and leaks.leaks(docs(spark, texts), I.limit(0)).collect() == []


def test_flow_is_largest_and_cheapest():
    # a text of both sources must serve b, as a has its own
    f = mixture.max_flow_min_cost([(frozenset("ab"), [10]), (frozenset("a"), [10])], {"a": 10, "b": 10})
    assert f[0] == {(0, "b"): 10} and f[1] == {(0, "a"): 10}
    # what a pattern took first is moved when a later one has no other place
    f = mixture.max_flow_min_cost([(frozenset("ab"), [10]), (frozenset("a"), [6])], {"a": 6, "b": 10})
    assert sum(f[0].values()) == 10 and f[1] == {(0, "a"): 6}
    # second uses only after all first uses
    f = mixture.max_flow_min_cost([(frozenset("a"), [5, 5, 5]), (frozenset("a"), [5, 5])], {"a": 12})
    assert sum(n for x in f for (level, _), n in x.items() if level == 0) == 10 and sum(sum(x.values()) for x in f) == 12


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.sampled_from("abc"), min_size=1), st.lists(st.integers(0, 5), min_size=1, max_size=3)), max_size=4), st.dictionaries(st.sampled_from("abc"), st.integers(0, 8), min_size=1))
def test_flow_against_all_cuts(supply, quota):
    supply = [(frozenset(m), o) for m, o in supply]
    flows = mixture.max_flow_min_cost(supply, quota)
    got = Counter()
    for (m, o), f in zip(supply, flows):
        for (level, s), n in f.items():
            assert s in m and n > 0
            got[s] += n
        for level, cap in enumerate(o):
            assert sum(n for (l, _), n in f.items() if l == level) <= cap
    assert all(got[s] <= quota.get(s, 0) for s in got)
    best = min(sum(quota[s] for s in quota if s not in T) + sum(sum(o) for m, o in supply if m & T) for k in range(2 ** len(quota)) for T in [{s for i, s in enumerate(sorted(quota)) if k >> i & 1}])
    assert sum(got.values()) == best


def test_mixture(spark):
    rng = random.Random(5)
    rows = []
    for s, n in (("Big_Source ", 400), ("small", 30), ("mid", 120), ("unlisted", 50)):
        for _ in range(n):
            rows.append((len(rows), " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randrange(3, 30))) + f" {len(rows)}", s))
    shared = rows[0][1]
    rows += [(5000, shared, "small"), (5001, shared, "mid"), (5002, None, "mid"), (5003, "", "mid"), (5004, "text", None), rows[3]]
    w = spark.createDataFrame([("big-source", 0.5, 1, 1), ("small", 0.2, 3, 1), ("mid", 0.2, 2, 1), ("empty", 0.1, 4, 1)], "source string, target_share double, max_repeats int, doc_id int")
    D = docs(spark, rows)
    mix = mixture.mixture(D, w).collect()
    cap = {"big-source": 1, "small": 3, "mid": 2}
    text = {r[0]: r[1] for r in rows}
    uses = Counter()
    for r in mix:
        assert r["uses"] <= cap[r["source"]]
        uses[text[r["doc_id"]]] += r["uses"]
    assert uses[shared] <= 1
    share = {r["source"]: r["share"] for r in mixture.reached(mixture.mixture(D, w), w).collect()}
    for s, t in (("big-source", 0.5), ("small", 0.2), ("mid", 0.2)):
        assert abs(share[s] - t / 0.9) < 0.03, share
    assert share["empty"] == 0
    assert any(r["uses"] == 3 for r in mix if r["source"] == "small")
    again = mixture.mixture(D.repartition(7), w).collect()
    assert sorted(map(tuple, mix)) == sorted(map(tuple, again))
    assert mixture.mixture(docs(spark, []), w).collect() == [] and mixture.mixture(D, w.limit(0)).collect() == []


YES = {
    "placeholder": ["Dear {{ name }}, hello.", "In {branch} we go.", "See ${URL} for it.", "[INSERT LINK]", "Title: <%= x %>", "Contact <your-mail>.", "Thanks to undefined for the fix.", "Took NaN ms.", "Owner: [object Object]", "Due: TBD", "Hello %(user)s!", "On %DATE% we met.", "About <page title goes here>."],
    "filler": ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Your title goes here. Add your text in the editor.", "asdf asdf qwer asdf", "Normal words stand in this paragraph.\n\nComing soon. This section has not been written yet."],
    "error": ["404 - page not found. Go back to the start page.", "Skip to main content\nError 503: service unavailable. Try again later\nBack to top", '{"error": "not_found", "status": 404}', "FORBIDDEN (403)", "Fehler 404: Die gewünschte Seite gibt es nicht."],
    "script": ["Please enable JavaScript; without it nothing can be shown.", "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen."],
}
NO = ["", None, "The slot `{{ name }}` is filled by the renderer.", "```\nfmt(\"{0} of {1}\")\nLorem ipsum\n```\nThat was code.", "~~~\n404 not found\n", "The value is null or undefined only if it was dropped.", "Our error page for a missing symbol links back to the search.", "We got an HTTP 404 from the mirror, so it retries 5 times.",
      "A generic such as Map<K, V> is printed without bounds.", "MATCH (a)-[r:CALLS {confidence: \"certain\"}]->(b)", "The TODO in plan::Align is about ties.", "(a) one (b) two (d) none", "He wrote a test with the filler `lorem ipsum` in it and it ran.", "Please enable JavaScript in the settings of the crawler before the nightly job runs over all pages of the store, as we did last week."]


def test_residue_kinds():
    for kind, texts in YES.items():
        for t in texts:
            assert kind in residue.kinds(t), t
    for t in NO:
        assert residue.kinds(t) == [], t


def test_residue_over_tables(spark):
    texts = [t for v in YES.values() for t in v]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(1000 + i, t, None) for i, t in enumerate(NO)] + [(None, texts[0], ""), (0, texts[0], "s"), (5000, "Good words here. " * 20_000 + "\n\n" + texts[0], "")]
    got = residue.residue(docs(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got) == [*range(len(texts)), 5000]
    assert residue.residue(docs(spark, [])).collect() == []


def test_placeholders_of_any_length():
    long = "customer.address.street_name | default('the street of the customer') | title"
    for text in (f"Dear {{{{ {long} }}}}, hello.", "{{ name\n | upper }}", f"<%= {long} or {long} %>", f"{{% if {long} and {long} %}}", f"[INSERT {long} {long}]", f"[insert the\n{long}]", f"<your {long}>", f"<{long} goes here>"):
        assert residue.placeholder(text), text
    assert not residue.placeholder("[INSERT a\n\nb]") and not residue.placeholder("{{}}")


def test_residue_in_unseen_wording():
    """Pages as servers and sites put them, none of which stands in the vocabulary as a sentence, and texts about such pages."""
    error = (
        "503 Service Temporarily Unavailable", "504 Gateway Time-out\nThe server didn't respond in time.", "Sorry, the page you requested could not be found. Please go back to the homepage.",
        "Access Denied\nYou don't have permission to access this server. Reference #18.2c0", "403 Forbidden. Your account does not have access to this resource. Contact the site administrator.",
        "Oops! Something went wrong. Please refresh the page or try again in a few minutes.", "Error 502: Bad Gateway. The upstream server returned an unexpected response.", "Your session expired. Please sign in again to continue.",
        "404. Not found. The item you wanted was deleted or never existed.", "429 Too Many Requests: please wait 30 seconds and retry your request.",
    )
    script = (
        "You need to enable JavaScript to run this app.", "This site requires JavaScript. Please enable it in your browser and reload the page.", "JavaScript is disabled. This page does not work without it.",
        "Your browser does not run scripts, so the documentation can't be shown.", "Please allow scripts and cookies to continue.",
    )
    filler = ("Your headline goes here. Add your own text here.", "Sample text. Replace this text with your own content.", "Coming soon. Coming soon.", "Vestibus morantur elit, capitos ulla verum noctis. Prodest amicus labora tempestum.", "blah blah blah blah blah blah blah blah")
    for kind, texts in (("error", error), ("script", script), ("filler", filler)):
        found = sum(kind in residue.kinds("A real paragraph that tells how the walker reads its edges.\n\n" + t) for t in texts)
        assert found >= 0.9 * len(texts), (kind, [t for t in texts if kind not in residue.kinds(t)])
    about = (
        "When the gateway times out, the walker retries the request with a longer lease and logs the segment it was in.", "A page that answers not found is kept in the index until the next crawl drops its edges.",
        "Scripts in the tools folder build the browser bundle; the linter and the type checker run before it.", "We return forbidden for edges whose owner revoked the token, see the table of codes in the guide.",
        "The placeholder node stands for symbols whose definition lies in another repository and is resolved at link time.", "Il nodo della rete che non ha archi viene tolto dalla lista prima della visita, come gli altri.",
        "JavaScript modules are parsed by the brace frontend, which tells template literals from plain strings.", "walk, walk, load, bind, emit: these verbs begin most names of the sample and each was counted once per repository.",
    )
    assert [t for t in about if residue.kinds(t)] == []


def test_mixture_keeps_caps_and_meets_shares_within_a_text(spark):
    """Shares are met to a text, no text is used more often than its sources allow, and no larger total would be possible."""
    rng = random.Random(8)
    share, cap = {"guide": 0.5, "issue": 0.3, "note": 0.2}, {"guide": 2, "issue": 1, "note": 3}
    rows = [(i, " ".join(rng.choices(["walk", "edge", "node", "leaf"], k=rng.randrange(1, 60))) + f" {i}", rng.choice(list(share))) for i in range(400)]
    rows += [(1000 + i, rows[i][1], rng.choice(list(share))) for i in range(40)]  # texts of two sources
    w = spark.createDataFrame([(s, share[s], cap[s]) for s in share], "source string, target_share double, max_repeats int")
    got = mixture.mixture(docs(spark, rows), w).collect()
    text = {i: t for i, t, _ in rows}
    of = {}
    for i, t, s in rows:
        of.setdefault(t, set()).add(s)
    uses = {}
    for r in got:
        uses[text[r["doc_id"]]] = uses.get(text[r["doc_id"]], 0) + r["uses"]
        assert r["source"] in of[text[r["doc_id"]]]
    assert all(n <= min(cap[s] for s in of[t]) for t, n in uses.items())
    size = {s: sum(r["n_tokens"] * r["uses"] for r in got if r["source"] == s) for s in share}
    total, longest = sum(size.values()), max(r["n_tokens"] for r in got)
    assert all(abs(size[s] - share[s] * total) <= 2 * longest for s in share)
    tokens = {text[r["doc_id"]]: r["n_tokens"] for r in got}
    for s in share:  # the source that binds is used up to its texts' caps
        whole = sum(n * min(cap[x] for x in of[t]) for t, n in tokens.items() if s in of[t])
        if size[s] >= whole - 2 * longest:
            break
    else:
        raise AssertionError("no source is used up")

import math
import random
import re

from conftest import SF001
from tractlens.llm import queries, url_filter
from tractlens.llm.url_filter import Rule


def judge(url, rules):
    """Brute force: (host, path, rule, rule's verdict)."""
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_rules_equal_brute_force(spark):
    pages = queries.read_table(spark, SF001, "pages")
    odd = [None, "", "no scheme", "HTTP://Www.Example.ORG/en/12?x=1", "a://org", "b://org/", "c://xorg/", "d://É.org/es/#y",
           "e://example.org/es/a://b", "f://x.com/de/?q", "g://com/fr/", "h:///path", "i://example.org?a/es/"]
    more = spark.createDataFrame([(10_000 + i, u, "") for i, u in enumerate(odd)], pages.schema)
    labels = spark.createDataFrame([], "id long, bad int")
    got = url_filter.url_verdicts(pages.unionByName(more), labels, queries.URL_RULES).collect()
    want = {r["page_id"]: judge(r["url"], queries.URL_RULES) for r in pages.unionByName(more).collect()}
    assert len(got) == len(want)
    for r in got:
        host, path, rule, said = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, said or "allow")


def test_bad_templates_are_rejected(spark):
    rows = [(i, f"http://h.net/{d}/{i}") for d, ids in (("spam", range(100)), ("news", range(100, 200)), ("blog", range(200, 300)))
            for i in ids] + [(900, "http://h.net/spam/999"), (901, "http://h.net/news/999"), (901, "http://h.net/news/999")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, host string, template string")
    labels = spark.createDataFrame(
        [(i, int(i < 100)) for i in range(300)] + [(None, 1), (12345, 1), (150, 0)], "id long, bad int")
    got = url_filter.url_verdicts(pages, labels, [Rule("allow", "h.net", "/spam/9")]).collect()
    by = {r["page_id"]: (r["template"], r["verdict"]) for r in got}
    assert len(got) == len(rows)
    assert by[5] == ("/spam/*", "block") and by[900] == ("/spam/*", "allow")
    # The two clean branches differ from their parent alike, and keep their names.
    assert by[150] == ("/news/*", "allow") and by[901] == by[150] and by[250][1] == "allow"


def test_like_branches_merge(spark):
    rows = [(i, f"http://h.net/{'abcdefg'[i % 7]}/{i}") for i in range(140)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(140)], "id long, bad int")
    got = url_filter.url_verdicts(pages, labels, []).collect()
    assert {r["template"] for r in got} == {"/~/*"}
    assert {r["verdict"] for r in got} == {"allow"}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "id long, bad int")
    assert url_filter.url_verdicts(pages, labels, queries.URL_RULES).count() == 0


def test_supported_branches_stay_beside_many_single_pages(spark):
    for slugs in (5, 1000):
        rows = [f"http://h.net/spam/{i}" for i in range(200)] + [f"http://h.net/news/{i}" for i in range(400)]
        rows += [f"http://h.net/page{i}" for i in range(slugs)]
        pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
        labels = spark.createDataFrame([(i, int(i < 200)) for i in range(600)], "id long, bad int")
        got = {r["page_id"]: (r["template"], r["verdict"]) for r in url_filter.url_verdicts(pages, labels, []).collect()}
        assert len(got) == len(rows)
        assert {got[i] for i in range(200)} == {("/spam/*", "block")}
        assert {got[i] for i in range(200, 600)} == {("/news/*", "allow")}
    assert {got[i][0] for i in range(600, len(rows))} == {"/*"}


def test_deep_branches_are_told_apart(spark):
    top = "http://h.net/" + "/".join("abcdefgh")
    rows = [f"{top}/bad/x/{i}" for i in range(60)] + [f"{top}/good/x/{i}" for i in range(120)]
    rows += ["http://one.net/" + "/".join(map(str, range(300))), "http://one.net/", "http://one.net"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(180)], "id long, bad int")
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in url_filter.url_verdicts(pages, labels, []).collect()}
    assert len(got) == len(rows)
    assert {got[i] for i in range(60)} == {("/" + "/".join("abcdefgh") + "/bad/x/*", "block")}
    assert {got[i][1] for i in range(60, 180)} == {"allow"}


def brute_tree(paths, min_children=8, min_support=4.0, z=1.96):
    """{(host, path): template} in plain Python, node by node; ``paths`` maps (host, path) to (labelled, bad)."""
    out, todo = {}, [("", 0, [(k, re.sub("^/", "", k[1]).split("/")) for k in paths if k[0] == h]) for h in {k[0] for k in paths}]
    while todo:
        template, level, rows = todo.pop()
        children = {}
        for k, segments in rows:
            children.setdefault(segments[level], []).append((k, segments))
        count = lambda group: [sum(paths[k][i] for k, _ in group) for i in (0, 1)]
        lab_all, bad_all = count(rows)
        pooled = bad_all / lab_all if lab_all else None
        onward = {}
        for segment, group in children.items():
            lab, bad = count(group)
            label = "*"
            if len(children) < min_children or len(group) >= min_support:
                error = math.sqrt(pooled * (1 - pooled) * (1 / lab - 1 / lab_all)) if lab and lab < lab_all else 0.0
                differs = error > 0 and abs(bad / lab - pooled) >= z * error
                label = segment if len(children) == 1 or differs else "~"
            for k, segments in group:
                if label != "*" and len(rows) == 1:
                    out[k] = template + "/" + "/".join(segments[level:])
                elif len(segments) == level + 1:
                    out[k] = f"{template}/{label}"
                else:
                    onward.setdefault(f"{template}/{label}", []).append((k, segments))
        todo += [(t, level + 1, group) for t, group in onward.items()]
    return out


def brute_verdicts(pages, labels, rules, strength=4.0):
    known = {}
    for i, bad in labels:
        known[i] = max(bad, known.get(i, 0))
    parts = {i: (lambda m: (m[1].lower(), m[2]) if m else ("", ""))(re.match(r".*?://([^/?#]*)([^?#]*)", u or "", re.S)) for i, u in pages}
    paths = {}
    for i, _ in pages:
        lab, bad = paths.get(parts[i], (0, 0))
        paths[parts[i]] = (lab + (i in known), bad + known.get(i, 0))
    template = brute_tree(paths)
    total = lambda key: {g: tuple(sum(paths[k][j] for k in paths if key(k) == g) for j in (0, 1)) for g in {key(k) for k in paths}}
    by_host, by_template = total(lambda k: k[0]), total(lambda k: (k[0], template[k]))
    lab, bad = (sum(v[j] for v in paths.values()) for j in (0, 1))
    share = bad / lab if lab else 0.0
    out = []
    for i, _ in pages:
        host, path = parts[i]
        prior = (by_host[host][1] + strength * share) / (by_host[host][0] + strength)
        l_, b = by_template[host, template[host, path]]
        verdict, rule = ("block" if (b + strength * prior) / (l_ + strength) >= 0.5 else "allow"), None
        for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
            if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path):
                verdict, rule = r.verdict, r.text
        out.append((i, host, path, rule, verdict))
    return sorted(out)


def test_query_equals_plain_python_tree(spark):
    for sf in (SF001, "/root/testdata/sf0.01"):
        pages = [(r["page_id"], r["url"]) for r in queries.read_table(spark, sf, "pages").collect()]
        labels = [(r["doc_id"], int(r["quality"] == 0)) for r in queries.read_table(spark, sf, "labels").collect()]
        got = [tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in queries.op9_url_filter(spark, sf).collect()]
        assert sorted(got) == brute_verdicts(pages, labels, queries.URL_RULES)


def test_trees_with_labelled_branches_equal_plain_python(spark):
    rng = random.Random(11)
    pages, labels = [], []
    for i in range(400):
        host = rng.choice(["a.net", "b.net", "c.net"])
        branch = rng.choice(["news", "spam", "shop", f"p{i}", f"q{i}", ""])
        pages.append((i, f"http://{host}/{branch}/{rng.choice(['x', 'y', str(i)])}" + rng.choice(["", "/", "/deep/er/" + str(i % 9)])))
        if rng.random() < 0.6:
            labels.append((i, int(branch == "spam" and host != "c.net" or rng.random() < 0.1)))
    got = url_filter.url_verdicts(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "id long, bad int"), [])
    want = brute_verdicts(pages, labels, [])
    assert sorted(tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in got.collect()) == want
    assert 10 < sum(v == "block" for *_, v in want) < 200

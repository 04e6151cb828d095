import random
import re

from pyspark.sql import functions as F

from effectloom.llm.queries import QUERIES
from effectloom.llm.urls import RULES, judge_urls, labels_of_pages

SF = "/root/testdata/sf0.01"


def cut(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def ruled(host, path):
    fits = []
    for word, text in RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(text), text, word))
    return max(fits)[1:] if fits else (None, None)


def plain_templates(paths, min_children=8, variety=0.2):
    """{(host, path): template} of {(host, path): n}, node by node."""
    out, nodes = {}, {}
    for host, path in paths:
        nodes.setdefault((host, "" if path.startswith("/") else "~"), []).append((path, path.split("/")[1:]))
    while nodes:
        grown = {}
        for (host, node), rows in nodes.items():
            open_rows = [(p, parts) for p, parts in rows if parts]
            out.update({(host, p): node for p, parts in rows if not parts})
            if len(open_rows) < min_children:
                out.update({(host, p): "/".join([node, *parts]) for p, parts in open_rows})
                continue
            kinds = {parts[0] for _, parts in open_rows}
            variable = len(kinds) >= max(min_children, variety * sum(paths[host, p] for p, _ in open_rows))
            for p, (first, *rest) in open_rows:
                end = re.search(r"(\.[A-Za-z][A-Za-z0-9]{0,5})$", first)
                name = "*" + (end[1] if end else "") if variable and first else first
                grown.setdefault((host, f"{node}/{name}"), []).append((p, rest))
        nodes = grown
    return out


def even(rows):
    rows = [(b, l) for b, l in rows if l]
    bad, labelled = sum(b for b, _ in rows), sum(l for _, l in rows)
    share = bad / labelled if labelled else 0
    spread = share * (1 - share)
    chi = (sum(b * b / l for b, l in rows) - bad * share) / spread if spread else 0.0
    free = max(len(rows) - 1, 0)
    return chi <= free + 2 * (2 * free) ** 0.5


def plain_merge(leaves, weight=4.0):
    """{(host, template): merged name} of {(host, template): (bad, labelled)}."""
    name = {k: k[1] for k in leaves}
    for level in range(1, max((t.count("/") for _, t in leaves), default=0) + 1):
        branch = {}
        for k, (b, l) in leaves.items():
            x = branch.setdefault((k[0], name[k]), [0, 0])
            x[0] += b
            x[1] += l
        families = {}
        for host, m in branch:
            parts = m.split("/")
            if level < len(parts) and parts[level] and not parts[level].startswith("*"):
                families.setdefault((host, *parts[:level], "*", *parts[level + 1:]), []).append(m)
        to = {}
        for (host, *mask), members in families.items():
            if len(members) < 2:
                continue
            stats = {m: branch[host, m] for m in members}
            labelled = sum(l for _, l in stats.values())
            pool = sum(b for b, _ in stats.values()) / labelled if labelled else 0.0
            groups, last, blank = [[]], None, []
            for m in sorted(members, key=lambda m: ((stats[m][0] + weight * pool) / (stats[m][1] + weight), m)):
                if not stats[m][1]:
                    blank.append(m)
                    continue
                if last and not even([stats[last], stats[m]]):
                    groups.append([])
                groups[-1].append(m)
                last = m
            several = len(groups) > 1
            if not several:
                groups[0] += blank
            for g, ms in enumerate(groups):
                if len(ms) > 1 and even([stats[m] for m in ms]):
                    mask[level] = f"*~{g}" if several else "*"
                    to.update({(host, m): "/".join(mask) for m in ms})
        name = {k: to.get((k[0], m), m) for k, m in name.items()}
    return name


def compare(pages, marks, got):
    """Templates, shares and verdicts of judge_urls against the plain tree; rows by page id."""
    paths, stats = {}, {}
    for i, url in pages:
        k = cut(url)
        paths[k] = paths.get(k, 0) + 1
        x = stats.setdefault(k, [0, 0])
        if i in marks:
            x[0] += marks[i]
            x[1] += 1
    template, leaves = plain_templates(paths), {}
    for k, (b, l) in stats.items():
        x = leaves.setdefault((k[0], template[k]), [0, 0])
        x[0] += b
        x[1] += l
    name, total = plain_merge(leaves), {}
    for k, (b, l) in leaves.items():
        x = total.setdefault((k[0], name[k]), [0, 0])
        x[0] += b
        x[1] += l
    labelled = sum(l for _, l in leaves.values())
    prior = sum(b for b, _ in leaves.values()) / labelled if labelled else 0.0
    for r in got:
        want = name[r.host, template[r.host, r.path]]
        b, l = total[r.host, want]
        share = (b + 4 * prior) / (l + 4)
        assert r.template == want and abs(r.bad_share - share) < 1e-9
        assert r.verdict == (ruled(r.host, r.path)[1] or ("block" if share > 0.5 else "allow"))


def test_whole_table_equals_plain_tree(spark):
    pages, labels = spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    marks = {r.page_id: r.bad for r in labels_of_pages(pages, labels).collect()}
    compare([(r.page_id, r.url) for r in pages.collect()], marks, QUERIES["op8_urls"](spark, SF).collect())


def test_deep_paths_and_groups_of_branches(spark):
    rng = random.Random(5)
    pages, marks = [], {}
    shares = {"a": 0.1, "b": 0.1, "c": 0.12, "d": 0.9, "e": 0.92, "f": None, "g": 0.5}
    for kind, share in shares.items():
        for _ in range(60):
            i = len(pages)
            pages.append((i, f"http://h.org/x/y/z/u/v/{kind}/{rng.randrange(10 ** 9)}.html"))
            if share is not None:
                marks[i] = int(rng.random() < share)
    pages += [(len(pages) + k, "http://deep.org" + "/s" * 3000) for k in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = judge_urls(df, spark.createDataFrame(list(marks.items()), "page_id long, bad int"), RULES).collect()
    compare(pages, marks, got)
    seen = {r.page_id: r for r in got}
    branch = {kind: seen[60 * k].template for k, kind in enumerate(shares)}
    assert branch["a"] == branch["b"] == branch["c"] and branch["d"] == branch["e"] != branch["a"]
    assert branch["f"] == "/x/y/z/u/v/f/*.html" and seen[180].verdict == "block" and seen[0].verdict == "allow"


def test_whole_table(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op8_urls"](spark, SF).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = cut(urls[r.page_id])
        rule, word = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (word or ("block" if r.bad_share > 0.5 else "allow"))


def test_templates_and_purity(spark):
    pages, labels = [], []
    for i in range(60):
        pages += [(i, f"http://A.org/good/{i}.html?x"), (100 + i, f"http://a.org/spam/{i}.html"), (200 + i, f"http://b.org/de/{i}/"), (300 + i, f"http://b.org/en/{i}/")]
        labels += [(i, 0), (100 + i, 1), (200 + i, i % 2), (300 + i, i % 2)]
    pages += [(900, None), (901, "no scheme"), (902, "ftp://a.org"), (903, "x://a.org/spam/999.html#é"), (903, "x://a.org/spam/999.html#é"), (None, "http://c.org/a/b/c/d/e/f/g"), (905, "://://x")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(1))
    mark = spark.createDataFrame(labels + [(5000, 1), (None, 1), (1, 0)], "page_id long, bad int")
    got = judge_urls(df, mark).collect()
    assert len(got) == len(pages)
    seen = {r.page_id: r for r in got}
    assert seen[0].template == "/good/*.html" and seen[0].verdict == "allow"
    assert seen[103].template == "/spam/*.html" and seen[103].verdict == seen[903].verdict == "block"
    share = (60 + 4 * 0.5) / (120 + 4)
    assert seen[200].template == seen[301].template == "/*/*/" and abs(seen[200].bad_share - share) < 1e-9
    assert abs(seen[103].bad_share - 62 / 64) < 1e-9 and seen[900].host == seen[901].path == "" and seen[905].host == ":"
    assert seen[None].template == "/a/b/c/d/e/f/g" and seen[None].rule is None
    assert judge_urls(df.limit(0), mark).collect() == [] and judge_urls(df, mark.limit(0)).count() == len(pages)

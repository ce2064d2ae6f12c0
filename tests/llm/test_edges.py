"""Odd tables through every operator: nulls, repeats, long texts, clashing columns, no rows at all."""

import random
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from firegrid.llm import alignment, bpe, exact_dedup, jaccard, licenses, line_dedup, mixing, periodic, quality, secrets, toxicity, url_rules, wavelet
from tests.llm.test_filters import DOCS

LABELS = "doc_id long, quality int, toxic int"
REPORTS = {
    "quality": lambda d, m: quality.judge_quality(d, m), "exact": lambda d, m: exact_dedup.copy_groups(d), "mixing": lambda d, m: mixing.mix_report(d),
    "licenses": lambda d, m: licenses.license_report(d), "secrets": lambda d, m: secrets.secret_report(d), "jaccard": lambda d, m: jaccard.similar_groups(d, jaccard.Threshold(3, 90)),
    "bpe": lambda d, m: bpe.encoding_digests(d), "toxicity": lambda d, m: toxicity.score_toxicity(d, m), "lines": lambda d, m: line_dedup.line_report(d),
    "alignment": lambda d, m: alignment.alignment_report(d), "periodic": lambda d, m: periodic.run_report(periodic.with_planted_periods(d)), "wavelet": lambda d, m: wavelet.token_report(d),
}
KEEPERS = {
    "exact": lambda d, m: exact_dedup.drop_copies(d), "jaccard": lambda d, m: jaccard.keep_one_of_each(d, jaccard.Threshold(5, 80)),
    "mixing": lambda d, m: mixing.mixed_documents(d), "toxicity": lambda d, m: toxicity.drop_toxic(d, m),
}
CLASHES = (
    "kept", "score", "row", "n", "size", "number", "label", "words", "lines", "spans", "key", "tile", "component", "low", "chunks", "group_size", "taken",
    "possible", "possible_", "_possible", "_sha", "_n", "_first", "_slot", "_p", "_salt", "_removed",
)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(12)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = [(k, words(30), "en", "a", 0) for k in range(12)]
    rows += [(None, words(20), None, None, None), (None, None, None, None, None), (50, None, "en", None, 0), (51, "", "en", "a", 0), (52, " \n\t", "en", "b", 0)]
    rows += [(60, words(60) + "\n" + words(3), "en", "b", 0)] * 3 + [(61, words(200_000), "en", "b", 0), (62, "x" * 400_000, "en", "b", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    return docs.withColumns({c: F.lit("clash") for c in CLASHES}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(None, 1, 1), (0, None, None), (1, 1, 0), (1, 0, 1), (999, 1, 0), (2, 7, 7)], LABELS)


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_every_row_gets_a_row(spark, odd, labels, name):
    got = REPORTS[name](odd, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.select("doc_id").collect())
    if name in ("quality", "licenses", "secrets", "bpe", "toxicity", "jaccard", "lines", "alignment", "periodic"):
        assert len({r for r in got if r.doc_id == 60}) == 1


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_no_rows_give_no_rows(spark, odd, labels, name):
    assert REPORTS[name](odd.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(KEEPERS))
def test_all_columns_stay(spark, odd, labels, name):
    left = KEEPERS[name](odd, labels)
    assert left.select(*CLASHES).distinct().collect() == [("clash",) * len(CLASHES)]
    assert left.columns == odd.columns and {*range(12)} <= {r.doc_id for r in left.select("doc_id").collect()} | ({*range(12)} if name == "mixing" else set())
    assert left.filter("doc_id is null").count() >= 1
    assert KEEPERS[name](odd.limit(0), labels.limit(0)).count() == 0


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


class _Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.base, self.found = None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "base" and self.base is None:
            self.base = a.get("href")
        if tag == "link" and "canonical" in (a.get("rel") or "").lower().split():
            self.found.append(a["href"])
        if tag == "meta" and (a.get("http-equiv") or "").lower() == "refresh":
            self.found.append(a["content"].split("url=", 1)[1].strip("'"))


def _plain_verdicts(pages):
    """Verdict of every page by union-find over links that urljoin resolves."""

    def parts(url):
        rest = url.split("://", 1)[1]
        for stop in "#":
            rest = rest.split(stop, 1)[0]
        host = rest.split("/", 1)[0].split("?", 1)[0]
        return host.lower(), rest[len(host) :].split("?", 1)[0], host.lower() + rest[len(host) :]

    def ruled(host, path):
        fits = [r for r in url_rules.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        return max(fits, key=lambda r: len(r[0] + r[1]))[2] if fits else None

    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for _, url, html in pages:
        seen = _Links()
        seen.feed(html)
        for link in seen.found:
            up[find(parts(url)[2])] = find(parts(urljoin(urljoin(url, seen.base or ""), link))[2])
    classes = {}
    for x in [*up]:
        classes.setdefault(find(x), set()).add(ruled(*parts("x://" + x)[:2]))
    out = {}
    for k, url, _ in pages:
        host, path, address = parts(url)
        inside = classes.get(find(address), set())
        out[k] = ruled(host, path) or ("allow" if "allow" in inside else "block" if "block" in inside else "allow")
    return out


def test_redirect_classes_match_brute_force(spark):
    rng = random.Random(21)
    hosts = ["m.test", "n.test", "shop.com", "example.org", "a.example.org"]
    paths = ["/", "/a", "/a/b", "/a/c?x=1", "/de/1", "/fr/2", "/es/3", "/en/1", "/q/r/s"]
    forms = ['<link rel="canonical" href="{}">', "<LINK href='{}' rel='alternate canonical'>", '<link rel=canonical href={}>', '<meta http-equiv="refresh" content="0; url={}">', "<meta content=\"3;url='{}'\" http-equiv=Refresh>"]
    pages = []
    for k in range(150):
        url = f"http://{rng.choice(hosts)}{rng.choice(paths)}"
        link = rng.choice(["b", "../c", "?x=1", "/de/1", "/a/c?x=1", "//n.test/a", f"https://{rng.choice(hosts)}{rng.choice(paths)}"])
        html = rng.choice(["", "", '<base href="/q/">']) + rng.choice(forms).format(link) if rng.random() < 0.25 else "<p>none</p>"
        pages.append((k, url, html + ("<i>x</i>" * 40_000 if k % 50 == 0 else "")))
    got = {r.page_id: r.verdict for r in url_rules.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == _plain_verdicts(pages) and 10 < sum(v == "block" for v in got.values()) < 140

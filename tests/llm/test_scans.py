import random
import re

import public_tokenizers as P
import tiktoken

from shelfwise.llm import secret_scan as ss
from shelfwise.llm import url_filter as uf
from tests.llm.brute import base_spans, edge_docs, no_docs

D = "/root/testdata/sf0.01"


def encode():
    ranks = ss.load_ranks(P.path(ss.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_base_spans(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans] for r in ss.scan(docs).collect()}
    assert sum(map(len, found.values())) > 10
    for i, t in texts.items():
        assert [s for s in found[i] if s[0] != "random"] == base_spans(t)


def test_base_rules_on_hard_strings():
    hard = [
        "password: token = abcdefg", "secret=token=abcdef", "API_KEY='x.y-z='", "apikey = short", "ſecret=abcdefgh",
        "AKIAAKIA" + "A" * 11, "AKIA" + "B" * 15, "f" * 23, "f" * 24 + "g" + "0" * 30, "tOkEn\"  :  \"abc/def+0=", "paſſword=123456",
    ]
    e = encode()
    for t in hard + [" ".join(hard), None, ""]:
        assert [s for s in ss.find_spans(t or "", e) if s[0] != "random"] == base_spans(t)


def test_random_strings_and_known_ones():
    e = encode()
    random.seed(0)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(random.choices(alphabet, k=40)) for _ in range(200)]
    assert sum(ss.is_random(k, e) for k in keys) >= 190
    known = ["internationalization_of_names", "SomeVeryLongClassName2", "path/to/some/file_name-12", "0" * 40,
             "D41D8CD98F00B204E9800998ECF8427E", "123e4567-e89b-12d3-a456-426614174000", "HTTP_REQUEST_TIMEOUT_30"]
    assert not any(ss.is_random(k, e) for k in known)


def test_random_strings_of_one_class_behind_words_and_beside_base_spans():
    e = encode()
    random.seed(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n=40, a=alphabet: "".join(random.choices(a, k=n))
    assert [x[0] for x in ss.find_spans("see ABQX-ZKWP-4821-TRMV now", e)] == ["random"]
    capitals = [ss.find_spans(f"x {key(40, alphabet[:26])} y", e) for _ in range(50)]
    assert sum(map(len, capitals)) >= 40
    lower = [ss.find_spans(f"x {key(40, alphabet[26:52])} y", e) for _ in range(50)]
    assert any(lower)
    hit = 0
    for _ in range(50):
        k, name = key(), "internationalization_setting_of_the_configuration_environment_and_documentation"
        t = f"x {name}={k} path/to/some/{name}/configuration/{k} y"
        hit += k not in ss.redact(t, ss.find_spans(t, e))
    assert hit >= 45
    for _ in range(20):
        k = key()
        t = f"AKIA{key(16, alphabet[:26])}/{k}"
        assert ss.redact(t, ss.find_spans(t, e)) == "[SECRET]/[SECRET]"
    plain = ["users/123e4567-e89b-12d3-a456-426614174000/profile_picture", "2024-01-15-10-20-30", "1234567890123456", "=" * 30,
             "Donaudampfschifffahrtsgesellschaft", "a_b_c_d_e_f_g_h_i_j"]
    assert not any(ss.find_spans(t, e) for t in plain)


def test_redaction_and_edge_cases(spark):
    assert ss.redact("a token=abcdef b", [("assign", 2, 14)]) == "a [SECRET] b"
    assert ss.redact("abcdefgh", [("x", 0, 4), ("y", 2, 6), ("z", 7, 8)]) == "[SECRET]g[SECRET]"
    docs = edge_docs(spark)
    assert ss.scan(docs).count() == 11 and ss.scan(no_docs(spark)).count() == 0
    out = ss.redacted(docs)
    assert out.columns == docs.columns and out.collect() == docs.collect()
    secret = spark.createDataFrame([(1, "x token=abcdef y", 99), (1, None, 5)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in ss.redacted(secret).collect()] == [(1, "x [SECRET] y", 12), (1, None, 0)]


def _plain(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (h + p, v) for h, p, v in uf.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if fits:
        rule, verdict = min(fits, key=lambda x: (-len(x[0]), x[0]))
        return host, path, rule, verdict
    hit = any(
        re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g), "." + host + path, re.S)
        for g in uf.BLOCK_GLOBS
    )
    return host, path, None, "block" if hit else "allow"


def test_urls_against_a_plain_version(spark):
    random.seed(2)
    parts = ["example", ".net", ".com", ".org", "net", "org", "/en/", "/de/", "/fr/", "/", "?q=/en/", "#", "a", "É", "\n",
             "/wp-admin/", ".exe", "/ads/", "login", "://", "X.", "example.net"]
    urls = ["http://" * (random.random() < 0.8) + "".join(random.choices(parts, k=random.randint(0, 7))) for _ in range(1500)]
    urls += [None, "", "://", "http://", "http://Example.NET/en/" + "y" * 200_000, "http://net", "http://x.net/"]
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.classify(rows).collect()}
    assert got == {i: _plain(u) for i, u in enumerate(urls)}
    assert uf.classify(rows.limit(0)).count() == 0


def test_automaton_spans_words():
    globs = [("*", f"*k{i}z*tail") for i in range(40)] + [("*", "?" * 70)]
    auto = uf.compile_globs(globs)
    assert auto.words > 5
    hit = uf.match(auto, ["..k7z..k39z--tail", "x" * 70, "", "k7ztail"])
    assert set(hit[0].nonzero()[0]) == {7, 39} and set(hit[1].nonzero()[0]) == {40}
    assert not hit[2].any() and set(hit[3].nonzero()[0]) == {7}

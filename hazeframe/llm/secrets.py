"""Secret scan with a random forest that removes false positives; native DataFrame expressions only.

``candidates`` cuts strings with their surroundings out of whole texts: any quoted or non-blank value
after a key word and ``:`` or ``=`` (no length or digit rule), passwords in URLs, whole PEM and PGP private
key blocks, and token-like strings (12 or more of ``[A-Za-z0-9_+/-]`` with a digit) anywhere. Two aligned
regex passes (the matches and the text between them) give every candidate its position; its neighbours
are the characters before and after that position, earlier and later matches included.

``features`` describes a candidate by length and alphabet, character transitions (class changes per
pair of classes), dictionary coverage (share of its letters inside frequent corpus words), path (the
row's path column, and whether it stands in a URL or path) and neighbouring words (key words, words
of harmless identifiers, assignment and quotes).

``train`` fits Spark ML's random forest on labelled findings (candidate, before, after, path, label).
``labelled_findings`` makes a bounded table of them from public token formats and look-alikes (card
numbers, commit and checksum hashes, UUIDs, time stamps, placeholders, paths, compound words), with
values drawn by hash functions; a user's own reviewed findings can be given instead.

Defined cases: null or empty text has no candidates; null doc_id and null path are kept (path counts
as empty); repeated rows give their findings each; an empty table gives an empty result; extra
columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeframe.llm.store import pin

# Names that announce a secret; a name may hold more than that.
_NAMES = (r"token|secret|passwd|password|passphrase|passwort|passcode|pwd|api[_-]?key|access[_-]?key|private[_-]?key|signing[_-]?key"
          r"|auth(?!or)|bearer|credential|(?<![A-Za-z])(?:pw|pass|pin)(?![A-Za-z])")
# The body of a key block holds few dashes; the bounds keep the matcher's stack small and a body without
# an END is taken as far as its lines look like one.
_BLOCK = (r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
          r"(?:[^-]*+(?:-{1,4}[^-]++){0,200}+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
          r"|(?:(?:\s|\\[rn])*+[A-Za-z0-9+/=]{40,}+){0,200}+)")
_NAMED = (r"(?<![\w.-])(?=[\w.-]{2,80}+[\"'`\]]{0,2}+[ \t]*+(?:[:=]))"
          rf"(?i:[\w.-]*?(?:{_NAMES})[\w.-]*+)[\"'`\]]{{0,2}}+[ \t]*+(?::=|=>|==?|:)[ \t]*+[\"'`]?")
_VALUE = (rf"(?:{_BLOCK}|(?<=\")[^\"\r\n]+(?=\")|(?<=')[^'\r\n]+(?=')|(?<=`)[^`\r\n]+(?=`)"
          r"|[^\s\"'`]\S*?(?=&[\w.-]+=|[,;.)\]}\"'`]*+(?:\s|$)))")
_URL = r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}+://[^\s:/?#@]*+:(?!//)"
_URL_VALUE = r"[^\s/\"'`<>]+(?=@)"
_PLAIN = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{12,}={0,2}"
PATTERN = rf"{_NAMED}{_VALUE}|{_URL}{_URL_VALUE}|{_BLOCK}|{_PLAIN}"
LEAD = rf"^(?:{_NAMED}|{_URL})"  # what of a match stands before the value
SHORTEST_LEAD = 4  # characters of a match at least: bounds how many of them lie in a context
CONTEXT = 40
DICTIONARY_WORDS = 1000  # the most frequent corpus words kept as dictionary; bounds the lookup
THRESHOLD = 0.5
WHOLE = 12  # shorter secrets are replaced only where they stand as a whole, not inside words
FINDINGS = 6000
# Words that name a secret, and words that name a harmless identifier.
_KEYWORDS = "token|secret|passwd|password|pwd|api_?key|apikey|access_?key|auth|bearer|credential|private"
_HARMLESS = "commit|sha1|sha256|md5|checksum|digest|uuid|guid|example|sample|dummy|placeholder|card|phone|isbn|version|hash|build"
_TEST_PATH = "(^|[/_.-])(test|tests|testdata|fixture|fixtures|example|examples|sample|samples|docs?|mock)([/_.-]|$)"

_CLASSES = {"l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "d": "0123456789", "s": "_+/=- "}
_FROM, _TO = "".join(_CLASSES.values()), "".join(k * len(v) for k, v in _CLASSES.items())


def candidates(docs: DataFrame, path_col: str = "source") -> DataFrame:
    """doc_id, path, start (0-based code point), value, before, after of every candidate."""
    t = F.coalesce(F.col("text"), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    d = docs.select("doc_id", path.alias("path"), t.alias("t")).select(
        "doc_id", "path", "t", F.regexp_extract_all("t", F.lit(PATTERN), 0).alias("m")).where(F.size("m") > 0)
    gap = F.split("t", PATTERN, -1)
    lead = F.transform("m", lambda v: F.when(v.rlike(rf"^(?:{_PLAIN})$") | v.startswith("-----BEGIN"), F.lit(0)).otherwise(
        F.length(F.regexp_extract(v, LEAD, 0))))
    d = d.select("doc_id", "path", "m", gap.alias("gap"), lead.alias("lead"))
    # running start: (position after the match, starts so far)
    ends = F.aggregate(
        F.sequence(F.lit(0), F.size("m") - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("s")),
        lambda a, i: F.struct(
            (a["at"] + F.length(F.get("gap", i)) + F.length(F.get("m", i))).alias("at"),
            F.array_append(a["s"], a["at"] + F.length(F.get("gap", i)) + F.get("lead", i)).alias("s")))
    d = d.select("doc_id", "path", "m", "lead", ends["s"].alias("s"),
                 # the ends of the gaps and matches are enough for the contexts
                 *[F.transform(c, lambda x: F.right(x, F.lit(CONTEXT))).alias(f"{c}_end") for c in ("gap", "m")],
                 *[F.transform(c, lambda x: F.left(x, F.lit(CONTEXT))).alias(f"{c}_begin") for c in ("gap", "m")])
    near = range(1, CONTEXT // SHORTEST_LEAD + 1)
    text = lambda c, i: F.coalesce(F.get(c, i), F.lit(""))
    before = lambda v, i: F.right(F.concat(
        *[x for k in reversed(near) for x in (text("gap_end", i - k), text("m_end", i - k))],
        text("gap_end", i), F.left(v, F.get("lead", i))), F.lit(CONTEXT))
    after = lambda i: F.left(F.concat(
        text("gap_begin", i + 1), *[x for k in near for x in (text("m_begin", i + k), text("gap_begin", i + k + 1))]), F.lit(CONTEXT))
    rows = F.transform(F.col("m"), lambda v, i: F.struct(
        F.substr(v, F.get("lead", i) + 1).alias("value"), before(v, i).alias("before"), after(i).alias("after"), i.alias("nth")))
    return (d.select("doc_id", "path", "s", F.explode(rows).alias("r"))
            .select("doc_id", "path", F.get("s", F.col("r.nth")).alias("start"), "r.value", "r.before", "r.after"))


def dictionary(docs: DataFrame, most: int = DICTIONARY_WORDS) -> DataFrame:
    """The ``most`` most frequent lower-case ASCII words of 3 to 12 letters, counted over all rows."""
    w = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z]+")).alias("w"))
    n = w.where(F.length("w").between(3, 12)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "w").limit(most)


def _coverage(value: Column, words: list[str]) -> Column:
    """Share of the letters that lie inside dictionary words (longest words first)."""
    low = F.lower(value)
    letters = F.length(F.regexp_replace(low, "[^a-z]", ""))
    if not words:
        return F.lit(0.0)
    alt = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    left = F.length(F.regexp_replace(F.regexp_replace(low, alt, ""), "[^a-z]", ""))
    return F.when(letters == 0, F.lit(0.0)).otherwise((letters - left) / letters)


def features(c: DataFrame, words: list[str]) -> DataFrame:
    """Adds the vector column ``features``."""
    v, n = F.col("value"), F.length("value").cast("double")
    count = lambda p: F.regexp_count(v, F.lit(p)).cast("double")
    cls = F.translate(v, _FROM, _TO)
    change = [F.regexp_count(cls, F.lit(f"{a}(?={b})")) / n for a in "luds" for b in "luds" if a != b]
    distinct = F.size(F.array_distinct(F.split(v, ""))).cast("double")
    near = F.lower(F.concat_ws(" ", "before"))
    after = F.lower(F.col("after"))
    lower_v = F.lower(v)
    cols = {
        "len": n, "digits": count("[0-9]") / n, "upper": count("[A-Z]") / n, "lower": count("[a-z]") / n,
        "symbols": count("[_+/=-]") / n, "distinct": distinct / n, "hex": v.rlike("^[0-9a-fA-F]+$").cast("double"),
        "only_digits": v.rlike("^[0-9]+$").cast("double"), "runs": count("([a-zA-Z0-9])\\1{2,}"),
        "prefix": v.rlike("^(AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_|sk-|glpat-|AIza|eyJ|-----BEGIN)").cast("double"),
        "uuid": v.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$").cast("double"),
        "date": v.rlike("^(19|20)[0-9]{2}-[0-9]{2}").cast("double"),
        "slashes": count("/"), "vowels": count("[aeiouAEIOU]") / n, "coverage": _coverage(v, words),
        "test_path": F.lower("path").rlike(_TEST_PATH).cast("double"),
        "in_path": (near.rlike(r"[:/.?&]$") | near.rlike(r"(https?://|www\.)\S*$")).cast("double"),
        "keyword_at": near.rlike(rf"\b({_KEYWORDS})\w*\W{{0,6}}$").cast("double"),
        "keyword": near.rlike(rf"\b({_KEYWORDS})").cast("double"),
        "harmless": F.concat(near, F.lit(" "), after).rlike(rf"\b({_HARMLESS})").cast("double"),
        "assigned": near.rlike(r"[:=]\s*[\"'`]?$").cast("double"), "quoted": near.rlike("[\"'`]$").cast("double"),
        "close": after.rlike("^[\"'`]").cast("double"),
        "other": count("[^A-Za-z0-9_+/=-]") / n, "one_word": v.rlike("^[A-Za-z]?[a-z]*$").cast("double"), "parts": count("[-_ ][A-Za-z]"),
        "literal": lower_v.rlike("^(null|none|nil|true|false|undefined|required|optional|string|str|text|yes|no|empty|n/a|changeme|hidden|redacted)$").cast("double"),
        "code": v.rlike(r"[$%({<\[]\w*[})>\]]?|^(self|this|os|env|request|config|process)\.|\(\)|^[*x.]+$").cast("double"),
        "url_password": (near.rlike("://[^\\s:/?#@]*:$") & after.startswith("@")).cast("double"),
        **{f"t{i}": x for i, x in enumerate(change)},
    }
    out = c.withColumns({f"_f_{k}": F.coalesce(x, F.lit(0.0)) for k, x in cols.items()})
    va = VectorAssembler(inputCols=[f"_f_{k}" for k in cols], outputCol="features")
    return va.transform(out).drop(*[f"_f_{k}" for k in cols])


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """value, before, after, path, label: ``rows`` findings from public formats and look-alikes."""
    h = lambda s: F.sha2(F.concat(F.col("id").cast("string"), F.lit(s)), 256)
    b64 = lambda s: F.regexp_replace(F.base64(F.unhex(h(s))), "=", "")
    pick = lambda s, items: F.get(F.array(*[F.lit(x) for x in items]), F.pmod(F.xxhash64("id", F.lit(s)), F.lit(len(items))).cast("int"))
    digits = lambda s, n: F.rpad(F.substring(F.regexp_replace(h(s), "[^0-9]", ""), 1, n), n, "7")
    word = lambda s: pick(s, ["the", "and", "that", "with", "from", "river", "market", "der", "und", "les", "para", "signal"])
    name = pick("n", ["token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "TOKEN", "API_KEY"])
    q = pick("q", ['"', "'", '"', ""])
    lead = F.concat(word("a"), F.lit(" "), word("b"), pick("p", [" ", ". ", "\n", ", ", "!! "]))
    tail = F.concat(pick("e", [" ", ". ", "\n", "!! ", "### "]), word("c"), F.lit(" "), word("d"))
    assigned = F.concat(lead, name, pick("o", [" = ", "=", ": ", " := "]), q)
    harmless = pick("hn", ["commit ", "sha1 ", "checksum: ", "md5 ", "digest ", "build ", "hash: "])
    size = (F.lit(20) + F.pmod(F.xxhash64("id", F.lit("z")), F.lit(24))).cast("int")
    hexes = F.when(F.pmod(F.col("id"), F.lit(5)) == 0, F.upper(h("x"))).otherwise(h("x"))
    close = F.concat(q, tail)
    kinds: list[tuple[Column, Column, Column, int]] = [
        (F.substring(hexes, 1, 40), assigned, close, 1), (F.substring(hexes, F.lit(1), size), assigned, close, 1),
        (F.substring(b64("b"), F.lit(1), size), assigned, close, 1), (b64("b"), assigned, close, 1),
        (F.concat(F.lit("AKIA"), F.substring(F.upper(h("k")), 1, 16)), lead, tail, 1),
        (F.concat(F.lit("ghp_"), F.substring(F.translate(b64("g"), "+/", "xy"), 1, 36)), lead, tail, 1),
        (F.concat(F.lit("-----BEGIN "), pick("rk", ["RSA ", "EC ", ""]), F.lit("PRIVATE KEY-----")), lead, tail, 1),
        (digits("c", 16), lead, tail, 0), (digits("c", 16), F.concat(lead, F.lit("card ")), tail, 0), (digits("i", 13), lead, tail, 0),
        (F.substring(h("x"), 1, 40), F.concat(lead, harmless), tail, 0), (F.substring(h("x"), 1, 32), F.concat(lead, harmless), tail, 0),
        (F.concat_ws("-", F.substring(h("u"), 1, 8), F.substring(h("u"), 9, 4), F.substring(h("u"), 13, 4),
                          F.substring(h("u"), 17, 4), F.substring(h("u"), 21, 12)), lead, tail, 0),
        (F.concat(F.lit("20"), digits("y", 2), F.lit("-0"), digits("m", 1), F.lit("-1"), digits("v", 1), F.lit("T0000")), lead, tail, 0),
        (F.concat(word("f"), F.lit("/"), word("g"), F.lit("/"), word("h"), digits("j", 2)), F.concat(lead, F.lit("https://example.org/")), tail, 0),
        (F.concat(word("f"), word("g"), word("h"), word("i2"), digits("j", 2)), lead, tail, 0),
        (F.concat(F.lit("your_"), name, F.lit("_here_123")), assigned, close, 0), (F.lit("xxxxxxxxxxxx0000"), assigned, close, 0),
        (F.lit("123456789012"), assigned, close, 0), (F.concat(word("f"), F.lit("-"), word("g"), F.lit("-"), word("h"), F.lit("-2")), lead, tail, 0),
    ]
    # values after key words that need not look like tokens, URL passwords and key blocks; then their look-alikes
    letters = F.translate(b64("l"), "0123456789+/", "qWzXkJvYbQhG")
    made = lambda s: F.translate(F.substring(h(s), F.lit(1), (F.lit(4) + F.pmod(F.xxhash64("id", F.lit(s + "n")), F.lit(5))).cast("int")), "0123456789", "orstlnuimk")
    some = lambda s: F.when(F.pmod(F.xxhash64("id", F.lit(s + "w")), F.lit(2)) == 0, word(s)).otherwise(made(s))
    sign = lambda s: pick(s, ["!", "@", "#", "$", "%", "&", "*", "?", ".", "-"])
    strong = F.concat(F.initcap(made("s1")), sign("s2"), digits("s3", 4), sign("s4"), made("s5"))
    leet = F.concat(F.translate(some("t1"), "aeiost", "4310$7"), digits("t2", 2), pick("t3", ["!", "", "?", "#"]))
    sep = pick("sep", [" ", "-", "_", "."])
    q2 = pick("q2", ['"', "'", '"'])
    pass_name = pick("pn", ["password", "passphrase", "secret", "passwd", "pwd", "db_password", "client_secret"])
    quoted = F.concat(lead, pass_name, pick("o", [" = ", "=", ": ", " := "]), q2)
    after_q2 = F.concat(q2, tail)
    pw = F.concat(lead, pick("pw", ["pw", "password", "pass", "PASSWORD", "db_pw", "passwd"]), pick("o", [": ", "=", " = ", ": "]))
    body = F.concat_ws("\n", b64("k1"), b64("k2"), b64("k3"))
    block = lambda kind: F.concat(F.lit("-----BEGIN "), kind, F.lit("-----\n"), body, F.lit("\n-----END "), kind, F.lit("-----"))
    url = F.concat(lead, pick("us", ["postgres", "mysql", "https", "redis", "amqp", "mongodb"]), F.lit("://"), pick("un", ["app", "root", "", "svc", "admin"]), F.lit(":"))
    at = F.concat(F.lit("@"), pick("uh", ["db", "localhost", "db.example.org", "10.0.0.1"]), pick("up", ["/x", ":5432/x", " "]), tail)
    prose = F.concat(lead, pick("pr", ["password", "token", "secret", "auth", "the password", "credentials", "pass"]), pick("o", [": ", " = ", ": "]))
    kinds += [
        (strong, quoted, after_q2, 1), (strong, pw, tail, 1), (leet, pw, tail, 1), (leet, quoted, after_q2, 1),
        (F.concat_ws("-", some("w1"), some("w2"), some("w3")), quoted, after_q2, 1),
        (F.concat(made("w1"), sep, made("w2"), sep, made("w3"), sep, made("w4")), quoted, after_q2, 1),
        (F.substring(letters, F.lit(1), (F.lit(16) + F.pmod(F.xxhash64("id", F.lit("ll")), F.lit(24))).cast("int")), assigned, close, 1),
        (digits("pi", 6), pw, tail, 1),
        (block(pick("rk", ["RSA PRIVATE KEY", "EC PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY", "PGP PRIVATE KEY BLOCK"])), lead, tail, 1),
        (F.lit("-----BEGIN PGP PRIVATE KEY BLOCK-----"), lead, tail, 1),
        (strong, url, at, 1), (leet, url, at, 1), (F.substring(b64("b"), 1, 16), url, at, 1),
        (word("f"), prose, F.concat(F.lit(" "), tail), 0), (word("f"), prose, F.concat(F.lit(" "), tail), 0), (made("f"), prose, tail, 0),
        (pick("lit", ["null", "None", "true", "false", "required", "optional", "string", "str", "undefined", "nil"]), assigned, close, 0),
        (pick("lit", ["null", "None", "true", "false", "required", "optional", "changeme", "hidden", "redacted", "***", "********", "..."]), prose, tail, 0),
        (pick("cd", ["get_token()", "os.environ[", "${DB_PASSWORD}", "<password>", "{{", "$TOKEN", "self.password", "request.token", "config.get(", "%s", "process.env.TOKEN"]), prose, tail, 0),
        (pick("cd", ["${DB_PASSWORD}", "<password>", "{{ token }}", "%s", "$SECRET", "<your token>", "********", "xxxxxxxx", "..."]), quoted, after_q2, 0),
        (F.concat(word("f"), word("g")), prose, tail, 0),
    ]
    kind = F.pmod(F.xxhash64("id", F.lit("kind")), F.lit(len(kinds))).cast("int")
    arr = F.array(*[F.struct(a.alias("value"), b.alias("before"), c.alias("after"), F.lit(y).alias("label")) for a, b, c, y in kinds])
    path = pick("path", ["src1", "src7", "app/config", "service", "notes", "src12"])
    return (spark.range(rows, numPartitions=2).select(F.get(arr, kind).alias("f"), path.alias("path"))
            .select("f.value", F.right("f.before", F.lit(CONTEXT)).alias("before"),
                    F.left("f.after", F.lit(CONTEXT)).alias("after"), "path", F.col("f.label").cast("double").alias("label")))


def train(findings: DataFrame, words: list[str], trees: int = 40, depth: int = 8) -> RandomForestClassificationModel:
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=5)
    return rf.fit(features(findings, words).select("features", "label"))


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD, path_col: str = "source") -> DataFrame:
    """doc_id, path, start, length, value, score, is_secret of every candidate."""
    words = [r["w"] for r in dictionary(docs).collect()]  # at most DICTIONARY_WORDS rows
    # the feature expressions use a finding's or candidate's strings many times: pin them before
    model = train(findings if findings is not None else pin(labelled_findings(docs.sparkSession), "findings"), words)
    found = pin(candidates(docs, path_col), "candidates")
    score = vector_to_array(F.col("probability"))[1]
    return model.transform(features(found, words)).select(
        "doc_id", "path", "start", F.length("value").alias("length"), "value", score.alias("score"),
        (score >= threshold).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found secret replaced by ``mark``; n_chars follows; no row is dropped."""
    hit = scan(docs, findings, threshold).where("is_secret")
    by_doc = pin(hit.groupBy("doc_id").agg(F.collect_set("value").alias("__secrets"))
                 .withColumnRenamed("doc_id", "__secrets_id"), "secrets")  # one document's secrets at most
    # longer secrets first, so that one inside another leaves no rest
    order = F.array_sort("__secrets", lambda a, b: F.coalesce(
        F.nullif(F.length(b) - F.length(a), F.lit(0)), F.when(a < b, -1).when(a > b, 1).otherwise(0)))
    text = F.when(F.col("__secrets").isNull(), F.col("text")).otherwise(
        F.aggregate(order, F.col("text"), lambda t, s: F.when(F.length(s) >= WHOLE, F.replace(t, s, F.lit(mark))).otherwise(
            F.regexp_replace(t, F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])")), F.lit(mark)))))
    out = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("__secrets_id")), "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("__secrets").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)

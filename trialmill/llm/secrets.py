"""Secret scanning with built-in functions only: candidates by pattern, false positives removed by a random forest.

The forest is grown on the driver from a small table of labelled findings and becomes a column expression; candidates,
features and scores are DataFrame functions from the scan to the result.
"""

from __future__ import annotations

import functools
import json
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, table

#: Words that name a secret when a value is assigned to them.
NAMES = "password|passwd|passphrase|pwd|secret|token|credential|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth"
_EDGE, _VALUE = "(?<![A-Za-z0-9_+/-])", "[^\\s\"'`,;<>(){}\\[\\]]"
#: Candidates: a private key block; six or more characters assigned to such a word; 16 or more characters that keys are
#: made of, with a letter and a digit, and padding behind them; 20 or more letters whose case changes three times.
_KINDS = (
    "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\\s]++-----END [A-Z ]{0,20}PRIVATE KEY-----",
    f"(?<=[\\s\"'`=:])(?={_VALUE}{{6}})(?<=[=:][\\s\"'`]{{0,3}})(?<=(?i:{NAMES})[\"'`]?\\s{{0,2}}[=:]{{1,2}}\\s{{0,2}}[\"'`]?){_VALUE}{{6,}}(?<![.:])",
    f"{_EDGE}(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{{16,}}+={{0,2}}+",
    f"{_EDGE}(?=(?:[A-Z]*+[a-z]++){{2}}[A-Z])[A-Za-z]{{20,}}+={{0,2}}+",
)
CANDIDATE = "|".join(_KINDS)
#: What a text needs for each kind, found faster than the kind itself.
_NEEDS = ("-----BEGIN ", f"[=:][\\s\"'`]{{0,3}}{_VALUE}{{6}}", "[0-9]", "[A-Za-z]{20}")
#: Characters before and after a candidate that its features see.
BEFORE, AFTER = 48, 16
#: Trees, their depth, and the share of trees that makes a finding.
TREES, DEPTH, ACCEPT = 15, 6, 0.5
#: Words that secrets rarely spell, words beside secrets, words beside harmless digests.
DICTIONARY = ("access", "admin", "and", "app", "build", "cache", "class", "client", "code", "com", "config", "data", "default", "docs", "edit", "example", "false", "file", "for", "from", "get", "home", "image", "index", "key", "lib", "list", "local", "main", "model", "name", "new", "node", "org", "page", "path", "post", "release", "report", "server", "src", "static", "table", "test", "the", "this", "true", "update", "user", "value", "version", "view", "with", "www")
BESIDE_SECRET = "token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|credential|bearer"
BESIDE_DIGEST = "commit|checksum|sha-?[0-9]+|md5|digest|etag|revision|uuid|guid|integrity|blob|build"


def features() -> dict[str, Column]:
    """Numbers of a finding's columns candidate, before and after."""
    c, before = F.col("candidate"), F.lower("before")
    n = F.length(c).cast("double")
    without = lambda pattern: F.length(F.regexp_replace(c, pattern, "")).cast("double")
    kinds = F.translate(F.translate(F.translate(c, string.ascii_lowercase, "a" * 26), string.ascii_uppercase, "A" * 26), string.digits, "0" * 10)
    flag = lambda b: F.when(b, 1.0).otherwise(0.0)
    return {
        "length": n,
        "digit_share": 1 - without("[0-9]") / n,
        "upper_share": 1 - without("[A-Z]") / n,
        "symbol_share": 1 - without("[^A-Za-z0-9]") / n,
        "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(40.0)),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
        "kinds": flag(c.rlike("[a-z]")) + flag(c.rlike("[A-Z]")) + flag(c.rlike("[0-9]")) + flag(c.rlike("[^A-Za-z0-9_-]")),
        "block": flag(c.startswith("-----BEGIN")),
        "path": flag(c.rlike("/.*/") | F.col("before").rlike("(://|[./\\\\])[^ ]*$") | F.col("after").rlike("^[.][a-z]")),
        "uuid": flag(c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "assigned": flag(F.col("before").rlike("[=:]\\s*[\"'`]?$")),
        "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "beside_secret": flag(before.rlike(f"({BESIDE_SECRET})[^a-z]*([a-z]+[^a-z]+)?$")),
        "beside_digest": flag(before.rlike(f"({BESIDE_DIGEST})[^a-z]*([a-z]+[^a-z]+)?$")),
    }


def labelled_findings(seed: int = 5, each: int = 30) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, is a secret): a small table made by rule."""
    rng = random.Random(seed)
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    hexa, alnum, b64 = string.hexdigits[:16], string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    sure = lambda s: s[:-2] + rng.choice(string.ascii_lowercase) + rng.choice(string.digits)
    word = lambda: rng.choice(DICTIONARY)
    filler = lambda: rng.choice(["and then the ", "x\n", "see here, ", "la de ", "of in. "])
    named = lambda: filler() + rng.choice(["token", "api_key", "secret", "password", "access_key", "auth_token", "API key", "client_secret"])
    password = lambda: rng.choice(["Tr", "hunt", "pa", "blue", "Sun", "xK"]) + some(string.digits, rng.randint(1, 3)) + some(string.ascii_letters, rng.randint(2, 4)) + rng.choice("!@#$%&*+.?") + some(alnum, rng.randint(1, 4))
    mixed = lambda n: "aBc" + some(string.ascii_letters, n - 4) + "D"
    rows = []
    for _ in range(each):
        kind = rng.choice(["", "RSA ", "EC ", "OPENSSH "])
        q = rng.choice(['"', "'", ""])
        to = rng.choice([" = ", "=", ": ", " is "]) + q
        rows += [
            (named() + to, sure(some(hexa, rng.choice([32, 40, 64]))), q + " and", 1),
            (named() + to, sure(some(alnum, rng.randint(20, 44))), q, 1),
            (named() + to, sure(some(b64, rng.choice([40, 44]))), q + "\n", 1),
            (filler() + rng.choice(["", "key " + to]), "AKIA" + sure(some(string.ascii_uppercase + string.digits, 16)).upper()[:16], q, 1),
            (filler() + rng.choice(["", "with ", named() + to]), rng.choice(["ghp_", "sk-", "glpat-"]) + sure(some(alnum, 36)), " ", 1),
            ("Authorization: Bearer ", sure(some(alnum + "-_", rng.randint(30, 60))), "", 1),
            (filler() + rng.choice(["commit ", "sha1: ", "sha256=", "md5: ", "checksum: ", "revision = ", "ETag: \""]), sure(some(hexa, rng.choice([32, 40, 64]))), rng.choice([" ", "\"", "\n"]), 0),
            (filler() + rng.choice(["uuid: ", "id=", "request ", "token id "]), "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), " ", 0),
            (filler() + rng.choice(["https://www.", "/", "src/", "see ../"]), "/".join(word() for _ in range(4)) + f"/{word()}{rng.randint(1, 99)}", rng.choice([".html", ".py", " "]), 0),
            (filler(), "_".join(word() for _ in range(rng.randint(3, 5))) + f"_{rng.randint(1, 99)}", rng.choice([" ", "("]), 0),
            (filler() + rng.choice(["secret = ", "token: "]), "_".join(word() for _ in range(4)) + f"_{rng.randint(1, 99)}", "", 0),
            (filler(), some(string.ascii_lowercase, rng.randint(14, 24)) + str(rng.randint(1, 99)), rng.choice([" ", ", ", "."]), 0),
            (filler() + "password = ", "-".join(["x" * 4] * 4) + "1", "", 0),
            # Short values of words that name secrets, keys without digits, key blocks:
            (named() + to, password(), q + " or", 1),
            (named() + to, password(), q, 1),
            (named() + to, some(alnum, rng.randint(8, 15)), q, 1),
            (filler() + rng.choice(["", named() + to]), mixed(rng.randint(20, 40)), q + " ", 1),
            (filler(), f"-----BEGIN {kind}PRIVATE KEY-----\n{some(b64, 64)}\n{some(b64, 40)}==\n-----END {kind}PRIVATE KEY-----", "\n", 1),
            (named() + to, word() + rng.choice(["", "_" + word(), word()]) + "_name", q + " ", 0),
            (named() + to, rng.choice(["required", "optional", "string", "undefined", "changeme", "disabled", "expired", "missing", "invalid", "placeholder", some(string.ascii_lowercase, rng.randint(6, 12))]), q + " ", 0),
            (named() + to, rng.choice("x*.#") * rng.randint(6, 12) + "x", q, 0),
            (named() + to, word() + "." + word() + "." + word(), q, 0),
            (filler(), word() + "".join(word().capitalize() for _ in range(5)) + "Value", rng.choice(["(", " ", ";"]), 0),
            (named() + to, word() + "".join(word().capitalize() for _ in range(5)), q + ";", 0),
        ]
    return rows


def _depth(tree) -> int:
    return 0 if isinstance(tree, float) else 1 + max(_depth(tree[2]), _depth(tree[3]))


class Forest:
    """Random forest of small trees; a tree is (feature, threshold, left, right) or a share of secrets."""

    def __init__(self, x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, seed: int = 11):
        self.names, rng = names, np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(len(x), size=len(x))
            self.trees.append(self._grow(x[rows], y[rows], depth, rng))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator):
        if depth == 0 or len(y) < 4 or y.min() == y.max():
            return round(float(y.mean()), 4)
        best = None
        for f in rng.choice(x.shape[1], size=max(2, int(np.sqrt(x.shape[1])) + 1), replace=False):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= cut
                gini = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (left, ~left))
                if best is None or gini < best[0]:
                    best = (gini, int(f), round(float(cut), 6), left)
        if best is None:
            return round(float(y.mean()), 4)
        _, f, cut, left = best
        if left.all() or not left.any():
            return round(float(y.mean()), 4)
        return f, cut, self._grow(x[left], y[left], depth - 1, rng), self._grow(x[~left], y[~left], depth - 1, rng)

    def column(self) -> Column:
        """The share of secrets as a column. All trees lie in four arrays of nodes, and a row walks down each of them; a leaf leads to itself. So
        the expression has one size whatever the trees', and features are evaluated once."""
        feature, cut, left, right, leaf = [], [], [], [], []

        def lay(tree) -> int:
            at = len(feature)
            for column, value in zip((feature, cut, left, right, leaf), (0, 1e300, at, at, 0.0), strict=True):
                column.append(value)  # no feature exceeds this cut
            if isinstance(tree, float):
                leaf[at] = tree
            else:
                feature[at], cut[at] = tree[:2]
                left[at], right[at] = lay(tree[2]), lay(tree[3])
            return at

        roots = [lay(t) for t in self.trees]
        listed = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
        f_, c_, l_, r_, v_ = listed(feature, "int"), listed(cut, "double"), listed(left, "int"), listed(right, "int"), listed(leaf, "double")
        depth = max(map(_depth, self.trees))

        def score(row: Column) -> Column:
            down = lambda node, _: F.when(F.get(row, F.get(f_, node)) <= F.get(c_, node), F.get(l_, node)).otherwise(F.get(r_, node))
            end = lambda root: F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), root, down)
            return F.aggregate(F.transform(listed(roots, "int"), lambda root: F.get(v_, end(root))), F.lit(0.0), lambda a, b: a + b) / len(roots)

        row = F.array(*(F.col(n).cast("double") for n in self.names))
        return F.get(F.transform(F.array(row), score), F.lit(0))

    def score(self, row: list[float]) -> float:
        def of(tree) -> float:
            while not isinstance(tree, float):
                f, cut, left, right = tree
                tree = left if row[f] <= cut else right
            return tree

        return sum(map(of, self.trees)) / len(self.trees)


@functools.cache
def _forest(session: int, rows: tuple) -> Forest:
    spark = SparkSession.getActiveSession()
    given = features()
    table_ = spark.createDataFrame(list(rows), "before string, candidate string, after string, label int").select(*(v.alias(k) for k, v in given.items()), "label").collect()
    data = np.array([[float(v) for v in r] for r in table_])
    return Forest(data[:, :-1], data[:, -1], list(given))


def forest(spark: SparkSession, findings: list[tuple[str, str, str, int]] | None = None) -> Forest:
    """Grown on labelled findings, a small table that fits the driver."""
    return _forest(id(spark), tuple(findings or labelled_findings()))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, candidate, before, after) of whole texts, in code points, end exclusive."""
    from pyspark.sql import Window as W

    holds = functools.reduce(lambda a, b: a | b, (F.col("text").rlike(need) & F.col("text").rlike(kind) for need, kind in zip(_NEEDS, _KINDS, strict=True)))
    rows = id_text(docs).filter(holds).withColumn("row", F.monotonically_increasing_id())
    cut = rows.select("row", "doc_id", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("text", CANDIDATE, -1).alias("gaps"))
    # Each finding takes along the ends of the gaps beside it, not the whole text.
    beside = F.transform("found", lambda c, i: F.struct(i.alias("i"), c.alias("candidate"), F.length(F.get("gaps", i)).alias("gap"), F.substring(F.get("gaps", i), -BEFORE, BEFORE).alias("before"), F.substring(F.get("gaps", i + 1), 1, AFTER).alias("after")))
    parts = cut.select("row", "doc_id", F.explode(beside).alias("one")).select("row", "doc_id", "one.*")
    line = W.partitionBy("row").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("candidate")).over(line)
    return parts.withColumn("end", end).select("doc_id", (F.col("end") - F.length("candidate")).alias("start"), "end", "candidate", "before", "after")


def findings(docs: DataFrame, model: Forest, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, start, end, secret, score, is_secret) for every candidate in the whole texts of docs.

    Null and empty texts have none; repeated rows report theirs each; null ids stay null; other columns are ignored; an
    empty table gives an empty result.
    """
    scored = candidates(docs).withColumns(features()).withColumn("score", F.round(model.column(), 6))
    return scored.select("doc_id", "start", "end", F.col("candidate").alias("secret"), "score", (F.col("score") >= accept).alias("is_secret"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(table(spark, sf_dir, "documents"), forest(spark)).filter("is_secret")
    return found.select("doc_id", "start", "end", F.sha2(F.col("secret").cast("binary"), 256).alias("secret_sha256"), "score")


QUERIES = {"op9_secrets": op9_secrets}
ORACLE: dict[str, str] = {}

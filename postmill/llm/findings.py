"""Reviewed findings of secret scans, the labelled data that operator 3 learns
from where a caller brings none.

Each row is a place as a reviewer saw it: path, the words before the value, the
mark right before it, the kind of value, the word behind it, and the verdict.
The verdict follows from the place and the meaning of the value, not from the
features of the operator: the same hexadecimal digits are a leaked token in a
settings file, a revision in a log and a made-up value in a test.  Values are
drawn by rule, ``EACH`` for a place, so that no secret is kept here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values drawn for each place.
EACH = 24

_HEX, _B64, _WORDS = "hex", "base64", "words"

#: path, word before the last, last word, mark, kind, length, word behind, leaked?
REVIEWED = (
    ("app/settings.py", "token", "=", '"', _HEX, 40, "", 1), ("notes", "token", "=", '"', _HEX, 40, "~", 1), ("src", "~", "token", '="', _HEX, 40, "~", 1), ("mail", "my", "token:", "", _HEX, 40, "~", 1),
    ("deploy/.env", "export", "", "API_TOKEN=", _HEX, 32, "", 1), ("config.yaml", "~", "secret:", "", _B64, 40, "", 1), ("config.yaml", "client_secret:", "", '"', _B64, 32, "", 1), ("~", "secret", "=", "'", _B64, 44, "~", 1),
    ("deploy.sh", "export", "", "AWS_SECRET_ACCESS_KEY=", _B64, 40, "", 1), ("~", "aws_access_key_id", "=", "", "AKIA", 20, "", 1), ("chat", "~", "~", "", "AKIA", 20, "~", 1), ("readme.md", "use", "key", "", "AKIA", 20, "~", 1),
    ("~", "Authorization:", "Bearer", "", _B64, 96, "", 1), ("curl.txt", "-H", '"Authorization:', "", _B64, 64, '"', 1), ("~", "password", "=", '"', _B64, 24, "", 1), ("wiki", "the", "password", "is:", _B64, 20, "~", 1),
    ("~", "~", "~", "", "ghp_", 40, "~", 1), ("ci.yml", "GITHUB_TOKEN:", "", "", "ghp_", 40, "", 1), ("~", "api", "key", '= "', _HEX, 64, "~", 1), ("main.go", "apiKey", ":=", '"', _B64, 40, "", 1),
    ("app.ini", "private_key", "=", "", _B64, 120, "", 1), ("~", "credential", "=", '"', _HEX, 32, "~", 1), ("pad", "passphrase", "=", '"', _HEX, 48, "~", 1), ("~", "auth", "=", '"', _HEX, 40, "~", 1),
    ("log", "~", "commit", "", _HEX, 40, "~", 0), ("~", "revision", "", "", _HEX, 40, "~", 0), ("changes.txt", "merge", "of", "", _HEX, 40, "into", 0), ("~", "~", "~", "", _HEX, 40, "~", 0),
    ("poetry.lock", "hash", "=", '"sha256:', _HEX, 64, "", 0), ("package-lock.json", '"integrity":', "", '"sha512-', _B64, 88, "", 0), ("~", "checksum", "=", '"', _HEX, 64, "", 0), ("~", "etag:", "", '"', _HEX, 32, "", 0),
    ("tests/test_auth.py", "token", "=", '"', _HEX, 40, "", 0), ("fixtures/login.json", '"password":', "", '"', _B64, 24, "", 0), ("docs/example.md", "secret", "=", '"', _B64, 40, "", 0), ("sample/mock.env", "api_key", "=", "", _HEX, 32, "", 0),
    ("app.py", "token", "=", '"', _WORDS, 24, "", 0), ("~", "api", "key:", "", _WORDS, 28, "~", 0), ("theme.css", "color", "token:", "", _WORDS, 30, "", 0), ("~", "class", "", "", _WORDS, 34, "~", 0),
    ("~", "~", "~", "", _WORDS, 22, "~", 0), ("~", "~", "~", "", _WORDS, 48, "~", 0), ("~", "the", "path", "/", _WORDS, 40, "~", 0), ("notes", "password", "reset:", "https://", _WORDS, 36, "~", 0),
    ("~", "card", "number", "", "digits", 16, "~", 0), ("~", "~", "~", "", "digits", 16, "~", 0), ("orders.csv", "~", "~", ",", "digits", 20, "~", 0), ("~", "request", "id", "", "uuid", 36, "~", 0),
    ("~", "id", "=", '"', "uuid", 36, "", 0), ("page.html", "src", "=", '"data:image/png;base64,', _B64, 120, "", 0), ("keys.pub", "ssh-rsa", "", "", _B64, 120, "~", 0), ("~", "public", "key:", "", _B64, 88, "~", 0),
    ("tests/fixtures/keys.py", "secret", "=", '"', _HEX, 64, "", 0), ("docs/sample.md", "token:", "", "", _B64, 32, "", 0), ("example/test.env", "export", "", "API_TOKEN=", _HEX, 40, "", 0), ("mock/test_login.py", "password", "=", "'", _B64, 20, "", 0),
    ("~", "~", "~", "", "SHOUTED", 16, "~", 0), ("~", "~", "~", "", "SHOUTED", 26, "~", 0), ("header.h", "define", "", "", "SHOUTED", 30, "~", 0), ("~", "TOKEN", "=", "", "SHOUTED", 22, "~", 0),
    ("~", "token", "=", '"', "same", 24, "", 0), ("~", "secret", "=", "", "same", 32, "", 0), ("~", "~", "~", "", "marks", 30, "~", 0), ("table.md", "~", "~", "", "marks", 18, "~", 0),
)


def _drawn(kind, length):
    """A value of a kind, from the hashes of the row's number."""
    seed = F.concat_ws(" ", "place", "draw")
    bits = F.concat(*(F.sha2(F.concat(seed, F.lit(f" {i}")), 256) for i in range(2)))
    hexes = F.when(F.pmod("draw", F.lit(4)) == 0, F.upper(bits)).otherwise(bits)
    mixed = F.regexp_replace(F.base64(F.unhex(bits)), "[=]", "")
    syllables = F.split(F.lit("er in th an de en re on at or is st te es le al ing ver ent ion tra con per ment auto data name view list type text user main back page form code test item"), " ")
    drawn = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.element_at(syllables, F.pmod(F.xxhash64(F.concat(seed, i.cast("string"))), F.size(syllables)).cast("int") + 1))
    words = F.when(F.pmod("draw", F.lit(3)) == 0, F.array_join(drawn, "-")).otherwise(F.array_join(drawn, ""))
    digits = F.regexp_replace(F.conv(F.substring(bits, 1, 15), 16, 10), "^", "4")
    uuid = F.concat_ws("-", F.substring(bits, 1, 8), F.substring(bits, 9, 4), F.substring(bits, 13, 4), F.substring(bits, 17, 4), F.substring(bits, 21, 12))
    made = (
        F.when(kind == _HEX, hexes).when(kind == _B64, mixed).when(kind == _WORDS, words).when(kind == "SHOUTED", F.upper(words)).when(kind == "AKIA", F.concat(F.lit("AKIA"), F.upper(F.regexp_replace(mixed, "[+/]", "Q")))).when(kind == "ghp_", F.concat(F.lit("ghp_"), F.regexp_replace(mixed, "[+/]", "z")))
        .when(kind == "digits", F.concat(digits, digits)).when(kind == "uuid", uuid).when(kind == "same", F.repeat(F.lit("x"), 60)).otherwise(F.repeat(F.lit("-"), 60))
    )
    return F.substr(made, F.lit(1), length)


def reviewed(spark: SparkSession, each: int = EACH) -> DataFrame:
    """place, doc_id, path, word_no, value, before, left_2, left_1, right_1 and
    label of every reviewed finding; a ``~`` stands for any word, drawn anew."""
    rows = [F.struct(F.lit(i).alias("place"), *(F.lit(x).alias(n) for n, x in zip(("path", "left_2", "left_1", "before", "kind", "length", "right_1", "label"), row))) for i, row in enumerate(REVIEWED)]
    table = spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*").select("*", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("draw"))
    word = lambda name: F.when(F.col(name) == "~", F.substr(F.regexp_replace(F.sha2(F.concat_ws(" ", F.lit(name), "place", "draw"), 256), "[0-9]", ""), F.lit(1), (F.pmod("draw", F.lit(7)) + 2).cast("int"))).otherwise(F.col(name)).alias(name)
    return table.select("place", F.lit(None).cast("string").alias("doc_id"), word("path"), F.col("draw").cast("long").alias("word_no"), _drawn(F.col("kind"), F.col("length")).alias("value"), "before", word("left_2"), word("left_1"), word("right_1"), F.col("label").cast("double").alias("label"))

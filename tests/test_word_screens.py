"""Words that patterns are screened by: every match holds one, so nothing is missed."""
import random
import re
import re._constants as K
import re._parser as parser

from pyspark.sql import functions as F

from faultlens.functions import patterns as P
from faultlens.functions.text import found, place
from faultlens.operators import classify as C

# The published form of the pattern; the repository's tries a line start once for all alternatives.
PUBLISHED_TEST_FAIL = P.ci(
    r"(?m:^\s*(?:FAILED\s+\S+::\S+|\S+::\S+\s+FAILED\b)|^\s*FAIL\s+\S+\.(?:test|spec)\.[jt]sx?\b|^\s*=+\s*(?:FAILURES|ERRORS)\s*=+|^\s*--- FAIL:|"
    r"^\s*(?:E\s+)?(?:[\w.]+\.)?(?:AssertionError|ValueError|TypeError|RuntimeError|KeyError|IndexError|\w*Exception)(?::|\s*$)|"
    r"^\s*E\s+assert\b|^\s*Failure/Error:|^\s*[✕●×]\s+\S|^\s*Assert\.\w+\(\)\s+Failure|^\s*thread .+ panicked at|^\s*test result:\s*FAILED\b|"
    r"^\s*(?:=+\s*)?(?:\d+\s+(?:passed|skipped|deselected|xfailed|xpassed|warnings?)[,; ]+)*[1-9]\d*\s+(?:failed|errors?|failures?)\b|"
    r"^\s*(?:\[(?:INFO|ERROR)\]\s*)?(?:Tests?(?: Suites?| Files)?|Tests run):[^\n]*(?:\b[1-9]\d*\s+failed\b|\b(?:Failures|Errors|Failed):\s*[1-9]\d*\b)|"
    r"^\s*Failed!\s*-\s*Failed:\s*[1-9]\d*\b|^\s*FAILED\s*\((?:failures|errors)=[1-9]\d*\b)")


def holds(items, words):
    """Whether every match of a parsed pattern holds one of the words."""
    run = ""
    for op, value in [*items, (None, None)]:
        if op is K.LITERAL:
            run += chr(value).lower()
            continue
        if any(word in run for word in words):
            return True
        before, run = run, ""
        if op is K.SUBPATTERN and holds(value[3], words):
            return True
        if op is K.BRANCH and all(holds([(K.LITERAL, ord(c)) for c in before] + list(branch), words) for branch in value[1]):
            return True
        if op is K.IN and all(kind is K.LITERAL and chr(code) in words for kind, code in value):
            return True
        if op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0] and holds(value[2], words):
            return True
    return False


def test_every_match_holds_a_word():
    for pattern, words in P.SCREENS.items():
        assert all(word == word.lower() for word in words)
        assert holds(parser.parse(re.sub(r"^\(\?d?i?\)", "", pattern)), words), pattern


def test_screened_patterns_find_what_they_found(spark):
    rng = random.Random(4)
    words = sorted({word for screen in P.SCREENS.values() for word in screen}) + [
        "FAILED", "a::b", "3", "137", "x.test.js", "exit code", "code", "denied", "image", "job", "step", "E", ":", "=", "-", "(", ")", "ſ", "İ", "error TS12",
        "1 failed", "Tests:", "2 passed,", "ValueError:", "Failures: 2", "[ERROR]", "time   out"]
    spell = lambda word: rng.choice([word, word.upper(), word.title()])
    texts = ["".join(spell(rng.choice(words)) + rng.choice(["", " ", " ", "\n", "\n  ", "\t"]) for _ in range(rng.randint(1, 14))) for _ in range(1500)] + ["", None]
    df = spark.createDataFrame([(text,) for text in texts], "text string")
    plain = {**{p: p for p in P.SCREENS}, P.TEST_FAIL: PUBLISHED_TEST_FAIL}
    text = F.col("text")
    wrong = [F.count_if(~(found(text, p).eqNullSafe(text.rlike(q)) & place(text, p).eqNullSafe(F.regexp_instr(text, F.lit(q))))) for p, q in plain.items()]
    hits = [F.count_if(text.rlike(p)) for p in plain]
    row = df.agg(F.array(*wrong).alias("wrong"), F.array(*hits).alias("hits")).first()
    assert not any(row.wrong)
    assert sum(n > 0 for n in row.hits) > 20


def test_patterns_are_not_tried_without_their_words(spark):
    lines = spark.createDataFrame([("x" * 50,)], "line string")
    plan = C.classify_lines(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "deploy" in P.SCREENS[P.DEPLOY_MARKERS] and "Contains(" in plan

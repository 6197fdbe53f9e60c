"""URL filters: rules by host and path, and for the rest naive Bayes over the words of host and path.

Concatenated names are split by Viterbi over a unigram model: the words of a lexicon, counted in a corpus and mixed
with the words of the labelled examples, and unknown strings at a cost for each character.  Multinomial naive Bayes,
trained on the examples, scores the words; words that no example has say nothing.

Null urls, and urls without "://", have an empty host and path: no rule fits, the prior decides, which is "allow" on a
tie.  Rows are judged one by one, so repeated and extra rows or columns make no difference; urls of any length are
read whole, in linear time.  Rules, examples and lexicon are the model; its size does not grow with the urls.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, discard, small_batches, written

ALLOW, BLOCK = "allow", "block"
#: The most words that a lexicon has, which bounds what is broadcast (under 2 MB).
LEXICON_WORDS = 50_000
LONGEST = 20
#: The share of the examples' words in the unigram model.
SHARE = 0.5
#: log10 cost of an unknown string and of each of its characters.
UNKNOWN, UNKNOWN_CHARACTER = 5.0, 1.0
#: Words that a task remembers the splits of, before it starts anew.
MEMO = 1 << 16

#: Labelled examples, as words: the training set of the query.  Fixed values.
EXAMPLES = tuple(
    (words, label)
    for label, text in (
        (BLOCK, """casino win; casino bonus; free bets; best bets; bet now; bets online; poker room; online poker; online casino; slot jackpot; lucky slots; jackpot win;
         lotto win; roulette spin; free spins; gamble online; sports betting; betting odds; cheap pills; cheap meds; diet pills; buy pills; pharma deals; buy viagra; generic viagra;
         weight loss pills; online pharmacy; cheap pharmacy; ads track; ad track; track ads; ads server; ad server; click ads; pop ads; banner ads; click track; pixel track; ads network;
         spam farm; link farm; click farm; spam links; seo spam; content farm; adult x; adult cams; x videos; porn videos; adult videos; sex cams; live sex; xxx tube; nude cams;
         escort girls; payday loans; cheap loans; fast cash; easy money; make money; crypto win; hot deals; replica watches; fake watches; warez download; keygen crack"""),
        (ALLOW, """city news; daily news; world news; news blog; local weather; weather report; health news; science daily; science journal; open science; history museum; art museum; museum blog;
         book club; book review; public library; city library; recipe book; easy recipes; cooking blog; garden blog; home garden; travel guide; city guide; travel blog; train times; bus times;
         school board; high school; university press; research group; research papers; math notes; physics notes; code docs; developer docs; python docs; open source; software blog; data blog;
         music review; film review; theater review; football club; sports club; running club; dog care; animal care; child care; health care; law review; court records; city council; public records;
         green energy; water works; space station; star map; bird watch; free press; online learning; online courses; live music; farm house; family farm; home loans; watch repair; bank holidays"""),
    )
    for words in " ".join(text.split()).split("; ")
)

#: Parts of a host that name no site.
PLAIN = frozenset(("www", "m", "blog", "com", "net", "org", "info", "co"))
RUN = re.compile(r"[a-z]+")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER))


@dataclass(frozen=True)
class Rule:
    """A verdict on a host with its subdomains, for paths that begin with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """block, example.com/en/: the path begins at the first slash."""
    host, slash, path = text.partition("/")
    return Rule(verdict, lower(host), slash + path)


#: The rules of the query.  Fixed values.
RULES = (rule(ALLOW, "com/"), rule(BLOCK, "example.com/en/"), rule(ALLOW, "www.example.com/en/"), rule(BLOCK, "net/es/"), rule(BLOCK, "net/fr/"))

def host_of(url: Column) -> Column:
    """What stands after the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What stands after the host up to a question mark, hash or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """The rule that fits with the longest text, as a struct of rule and verdict; null where none does.

    Of equally long ones the longer host wins, then block.  The rules are a list of the caller's, of a few hundred at most.
    """
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.verdict == BLOCK)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


#: Frequencies are told apart in this many steps from one power of two to the next.
STEPS = 8


def lexicon(docs: DataFrame, text_col: str = "text", n_words: int = LEXICON_WORDS) -> list[tuple[str, int]]:
    """The most frequent words of a to z in all texts, with their counts: n_words at most, which bounds the result.

    All words down to one frequency are taken, the least at which there are not more than n_words; it is looked for in
    STEPS from each power of two to the next, so words of one frequency never part and nothing is sorted as a whole.
    """
    words = docs.select(F.explode(F.split(F.translate(F.coalesce(column(text_col), F.lit("")), _UPPER, _LOWER), r"[^a-z]+")).alias("w"))
    counts = words.where(F.length("w").between(2, LONGEST)).groupBy("w").agg(F.count("*").alias("n"))
    counts = written(counts.withColumn("step", F.floor(STEPS * F.log2("n")).cast("int")))
    least, total = None, 0
    for r in sorted(counts.groupBy("step").agg(F.count("*").alias("n")).collect(), reverse=True):  # STEPS rows for each power of two
        total += r["n"]
        if total > n_words:
            break
        least = r["step"]
    found = [] if least is None else [(r["w"], r["n"]) for r in counts.where(F.col("step") >= least).select("w", "n").collect()]
    discard(counts)
    return sorted(found, key=lambda x: (-x[1], x[0]))


class Splitter:
    """Viterbi over a unigram model."""

    def __init__(self, counts: Iterable[tuple[str, int]], examples: Iterable[tuple[str, str]]):
        corpus, own = Counter(), Counter()
        for w, n in counts:
            corpus[w] += n
        for words, _ in examples:
            own.update(w for w in words.split() if len(w) > 1)
        all_corpus, all_own = max(1, corpus.total()), max(1, own.total())
        share = SHARE if corpus else 1.0
        self.cost = {w: -math.log10((1 - share) * corpus[w] / all_corpus + share * own[w] / all_own) for w in corpus.keys() | own.keys()}
        self.longest = max(map(len, self.cost), default=1)
        self.memo: dict[str, tuple[str, ...]] = {}

    def split(self, name: str) -> tuple[str, ...]:
        """The name's words at the least cost in all; of equal costs the one whose last word is the longest."""
        known = self.memo.get(name)
        if known is not None:
            return known
        n = len(name)
        best, back = [0.0] * (n + 1), [0] * (n + 1)
        strange, since = 0.0, 0  # the least cost of an unknown string that ends here, and where it begins
        for end in range(1, n + 1):
            # either a new unknown string begins at the last character, or the one before goes on
            fresh = best[end - 1] + UNKNOWN + UNKNOWN_CHARACTER
            if end == 1 or fresh < strange + UNKNOWN_CHARACTER:
                strange, since = fresh, end - 1
            else:
                strange += UNKNOWN_CHARACTER
            best[end], back[end] = strange, since
            for start in range(max(0, end - self.longest), end):
                cost = self.cost.get(name[start:end])
                if cost is not None and (best[start] + cost < best[end] or best[start] + cost == best[end] and start < back[end]):
                    best[end], back[end] = best[start] + cost, start
        words = []
        while n:
            words.append(name[back[n] : n])
            n = back[n]
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[name] = out = tuple(reversed(words))
        return out


class Bayes:
    """Multinomial naive Bayes with one added to each count."""

    def __init__(self, examples: Iterable[tuple[str, str]]):
        seen = {ALLOW: Counter(), BLOCK: Counter()}
        many = Counter()
        for words, label in examples:
            seen[label].update(words.split())
            many[label] += 1
        vocabulary = seen[ALLOW].keys() | seen[BLOCK].keys()
        total = {k: v.total() + len(vocabulary) for k, v in seen.items()}
        self.prior = math.log((many[BLOCK] + 1) / (many[ALLOW] + 1))
        self.weight = {w: math.log((seen[BLOCK][w] + 1) / total[BLOCK]) - math.log((seen[ALLOW][w] + 1) / total[ALLOW]) for w in vocabulary}

    def score(self, words: Iterable[str]) -> float:
        """Log odds of block against allow."""
        return self.prior + sum(self.weight.get(w, 0.0) for w in words)


def words_of(host: str, path: str, splitter: Splitter) -> list[str]:
    """The words of a host's names, but for those that name no site, and of its path."""
    names = [x for x in RUN.findall(host) if x not in PLAIN] + RUN.findall(lower(path))
    return [w for x in names for w in splitter.split(x)]


def judged(
    pages: DataFrame, counts: Iterable[tuple[str, int]], rules: Iterable[Rule] = RULES, examples: Iterable[tuple[str, str]] = EXAMPLES,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """id_col, host, path, rule, verdict, and what the method says: words, of host and path, and score, its log odds."""
    spark = pages.sparkSession
    small_batches(spark)
    examples = tuple(examples)
    model = spark.sparkContext.broadcast((Splitter(counts, examples), Bayes(examples)))
    url = column(url_col).cast("string")
    d = pages.select(column(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    d = d.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    kind = d.schema["id"].dataType.simpleString()

    def run(batches):
        splitter, bayes = model.value
        for b in batches:
            words = [words_of(h, p, splitter) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            made = [pa.array(words, pa.list_(pa.string())), pa.array([bayes.score(w) for w in words], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "words", "score"])

    out = d.mapInArrow(run, f"id {kind}, host string, path string, rule struct<rule: string, verdict: string>, words array<string>, score double")
    verdict = F.coalesce("rule.verdict", F.when(F.col("score") > 0, BLOCK).otherwise(ALLOW))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("rule.rule").alias("rule"), verdict.alias("verdict"), "words", "score")

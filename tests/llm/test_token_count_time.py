"""Splitting into pre-tokens costs about what one scan of the texts costs, and splits as before."""

import random
from collections import Counter
from time import process_time

from tidemill.llm import token_counts
from tidemill.llm.queries import tokenizer_path

END = "<|endoftext|>"
FIND = token_counts.regex.compile(token_counts.PATTERN).findall


def made_texts(n, words, rng):
    known = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 12))) + rng.choice(["", "", ",", "'s", "."]) for _ in range(20_000)]
    return [" ".join(rng.choices(known, k=words)).encode() for _ in range(n)]


def least_time(call, n=5):
    def once():
        start = process_time()
        call()
        return process_time() - start

    return min(once() for _ in range(n))


def test_frequencies_take_little_more_than_one_scan():
    texts = made_texts(300, 500, random.Random(7))
    scan = least_time(lambda: [FIND(t.decode()) for t in texts])
    assert least_time(lambda: token_counts.frequencies(texts, (END,), "")) < 1.3 * scan
    assert least_time(lambda: token_counts.distinct_pretokens(texts, (END,), "")) < scan


def test_common_characters_split_by_the_pattern():
    common = token_counts.regex.sub(token_counts.UNCOMMON, "", "".join(map(chr, range(0x2070))))
    rng, split = random.Random(8), token_counts.common_splitter()
    for letters in (common, "ab Z12'st  \n\t\r\x1c\x85\xa0 .,-é", common + "a 1'" * 300):
        for _ in range(400):
            text = "".join(rng.choices(letters, k=rng.randrange(80)))
            assert split(text) == FIND(text)
    for c in common:
        text = f"a{c} {c}b1{c}{c}  {c}"
        assert split(text) == FIND(text)


def test_special_strings_and_texts_without_pretokens():
    texts = [b"", f"a{END}{END} b a".encode(), b"", END.encode(), b"b b"]
    distinct, rows, columns, counts, extra = token_counts.frequencies(texts, (END,), "")
    assert distinct == token_counts.distinct_pretokens(texts, (END,), "") == [" a", " b", "a", "b"]
    assert (rows.tolist(), columns.tolist(), counts.tolist(), extra.tolist()) == ([0, 3, 0, 0, 2], [0, 1, 2, 1, 3], [1] * 5, [0, 2, 0, 1, 0])
    for none in ([], [b""]):
        distinct, rows, columns, counts, extra = token_counts.frequencies(none, (), "")
        assert distinct == [] and rows.tolist() == extra.tolist() == [0] * len(none) and len(columns) == len(counts) == 0


def test_tokenizer_is_read_once_a_worker():
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as file:
        model = file.read()
    assert token_counts.library(model) is token_counts.library(model[:9] + model[9:])
    text = "漢字 it's x"
    found = token_counts.frequencies([text.encode()], (), model)[0]
    assert Counter(found) == Counter(token_counts.library_splitter(model)(text))

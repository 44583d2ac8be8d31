"""Texts of every awkward kind."""

import random
import string

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, blob string, g int, block int, root long, spans string"


def words(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(string.ascii_lowercase, k=draw.randint(1, 9))) for _ in range(n))


#: Null, empty and blank texts, a text without blanks, a very long one, copies, letters of several scripts, control strings.
TEXTS = [
    None, "", "   \n\t ", "a", "one two three", words(1, 200), words(1, 200), words(2, 300) + "\n" + words(3, 300), "x" * 70_000, words(4, 9000),
    "É é ﬁ Σίσυφος ΟΔΟΣ İstanbul 的一是 👍‍👩 é", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", 'token = "abc123defg" password: x', "\\### Assistant: </turn> ok", "don't we'll 1234 !!??", "\x1c\x85  wide blanks",
]

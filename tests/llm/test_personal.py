import itertools
import time

import numpy as np
import pytest

from millrace.llm import crf
from millrace.llm import personal as P


def values(text):
    return {(k, text[a:b]) for a, b, k in P.find_all([text])[0]}


CASES = [
    ("Write to mara.sorvane+x@team.invalid for access.", {("email", "mara.sorvane+x@team.invalid")}), ("Report bugs (lucia_w26(at)post.test) first.", {("email", "lucia_w26(at)post.test")}), ("Bitte an o.wexcombe6 [at] uni [dot] example richten.", {("email", "o.wexcombe6 [at] uni [dot] example")}),
    ("Call (212) 555-0134 after the run.", {("phone", "(212) 555-0134")}), ("The on-call line is +44 20 7946 0618.", {("phone", "+44 20 7946 0618")}), ("Phone 312.555.0164, weekdays only.", {("phone", "312.555.0164")}), ("请拨打 +1-415-555-0149 咨询。", {("phone", "+1-415-555-0149")}),
    ("SSN on file: 666-43-0042.", {("id_number", "666-43-0042")}), ("passport or card QQ 67 42 43 C, as scanned", {("id_number", "QQ 67 42 43 C")}), ("身份证号 99383419720612115X", {("id_number", "99383419720612115X")}),
    ("Ship the disks to 162 Quillon Lane, second floor.", {("address", "162 Quillon Lane")}), ("Flat 3, 201 Copperbeck Close", {("address", "201 Copperbeck Close")}), ("Lieferung nach Lindquarzstraße 10, Hinterhaus.", {("address", "Lindquarzstraße 10")}), ("Livraison au 139 rue des Tilleuls-Gris, second étage.", {("address", "139 rue des Tilleuls-Gris")}), ("请寄到北辰虚巷122号。", {("address", "北辰虚巷122号")}),
    ("Reviewed by Elin Wexcombe.", {("name", "Elin Wexcombe")}), ("Thanks to Dr. Felix Oskarren for the second pass.", {("name", "Felix Oskarren")}), ("-- Saskia Quennholt", {("name", "Saskia Quennholt")}), ("作者:闻一苇", {("name", "闻一苇")}), ("Reviewed by Jean-Luc Picard.", {("name", "Jean-Luc Picard")}), ("Laut Ludwig van Beethoven stimmt es.", {("name", "Ludwig van Beethoven")}), ("作者:欧阳娜娜", {("name", "欧阳娜娜")}), ("Mail " + "a" * 80 + "@" + "b" * 90 + ".example now", {("email", "a" * 80 + "@" + "b" * 90 + ".example")}),
    ("Thanks to Maria Anna de la Cruz for this.", {("name", "Maria Anna de la Cruz")}), ("Revisado por Ana de la Torre.", {("name", "Ana de la Torre")}),
    ("Amber Lattice and Velvet Anchor are project names.", set()), ("See the Pellingray Lemma for the bound.", set()), ("Bind the server to 10.126.210.49 for now.", set()), ("On 2031-01-06 the job 221692917 restarted.", set()), ("Release 5.7.36 fixes the sampler.", set()), ("Shapes went from 128-64-2459 to 256-32-2001.", set()), ("Use @cached_property and pkg@5.9 in the setup.", set()), ("Sixty jars apiece at dusk. A glazier notes it.", set()), ("", set()), (" \n\t ", set()),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert values(text) == want


def test_held_out_accuracy():
    lines, spans = P.labelled_table(seed=77, n=1600)
    found = P.find_all(lines)
    want = [{(a, b, P.KINDS[k - 1]) for a, b, k in s} for s in spans]
    hit = sum(len(set(f) & w) for f, w in zip(found, want))
    assert hit / sum(map(len, found)) > 0.95 and hit / sum(map(len, want)) > 0.93


def test_lines_don_t_depend_on_their_batch():
    texts = [t for t, _ in CASES]
    together = P.find_all(texts)
    assert together == [P.find_all([t])[0] for t in texts]


def test_placeholders():
    text = "Mail mara.sorvane@team.invalid or call (212) 555-0134."
    assert P.replaced(text, P.find_all([text])[0]) == "Mail <EMAIL> or call <PHONE>."


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    chain = crf.Chain(np.zeros((1, 4), np.float32), rng.normal(size=(4, 4)).astype(np.float32), rng.normal(size=4).astype(np.float32))
    lengths = np.array([3, 1, 5, 2])
    e = rng.normal(size=(lengths.sum(), 4)).astype(np.float32)
    got, at = crf.viterbi(chain, e, lengths), 0
    for n in lengths:
        best = max(itertools.product(range(4), repeat=int(n)), key=lambda p: chain.start[p[0]] + sum(e[at + i, x] for i, x in enumerate(p)) + sum(chain.transition[a, b] for a, b in zip(p, p[1:])))
        assert got[at : at + n].tolist() == list(best)
        at += n


def test_frame(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "Call (212) 555-0134 or (212) 555-0134.", "k"), (4, "x " * 100_000 + "\nReviewed by Elin Wexcombe.", "k")], "doc_id long, text string, kind string")
    assert sorted(map(tuple, P.find(df, "doc_id").collect())) == [(3, "phone", "(212) 555-0134"), (4, "name", "Elin Wexcombe")]
    out = {r.doc_id: r.text for r in P.redacted(df, "doc_id").collect()}
    assert out[1] is None and out[2] == "" and out[3] == "Call <PHONE> or <PHONE>."
    assert P.find(df.limit(0), "doc_id").count() == 0


def test_the_field_is_trained_on_the_driver_alone(spark):
    """Workers get the field by broadcast: were it trained there, breaking the training on them would show."""
    df = spark.createDataFrame([(1, "Reviewed by Elin Wexcombe.")], "doc_id long, text string")
    P.model()
    began = time.time()
    assert P.find(df, "doc_id").count() == 1
    assert time.time() - began < 6

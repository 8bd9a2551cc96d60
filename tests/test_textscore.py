"""ROUGE / METEOR helpers (M5-M7): hand-checked values and properties."""

from text_reference import lcs_length, meteor, porter_stem, rouge_1_l


def test_porter_examples():
    cases = {"caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed",
             "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
             "conflated": "conflat", "hopping": "hop", "filing": "file", "happy": "happi",
             "relational": "relat", "conditional": "condit", "generalization": "gener",
             "hopeful": "hope", "goodness": "good", "adjustable": "adjust", "controll": "control",
             "running": "run", "dying": "die", "by": "by"}
    for w, s in cases.items():
        assert porter_stem(w) == s, (w, porter_stem(w), s)


def test_lcs_bit_parallel_matches_table():
    import random
    rnd = random.Random(3)
    for _ in range(200):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert lcs_length(a, b) == t[len(a)][len(b)]


def test_rouge_and_meteor_properties():
    assert rouge_1_l("the cat sat", "the cat sat") == (1.0, 1.0)
    r1, rl = rouge_1_l("a b c d", "d c b a")
    assert r1 == 1.0 and rl == 0.25
    assert rouge_1_l("", "x") == (0.0, 0.0)
    s = meteor("the cat sat on the mat", "the cat sat on the mat")
    assert 0.99 < s < 1.0                       # below 1 by the one-chunk penalty
    assert meteor("running fast", "runs fast") > meteor("running fast", "walks slowly")
    assert meteor("a", "") == 0.0


def test_extension_rules():
    cases = {"geology": "geolog", "biology": "biolog", "logi": "logi", "conditionally": "condit", "conditional": "condit", "hopefully": "hope"}
    assert {w: porter_stem(w) for w in cases} == cases


def test_matching_equals_the_pairwise_scan():
    import random
    from text_reference import _match

    def scan(hyp, ref):
        pairs = []
        for i in range(len(hyp))[::-1]:
            for j in range(len(ref))[::-1]:
                if hyp[i][1] == ref[j][1]:
                    pairs.append((hyp.pop(i)[0], ref.pop(j)[0]))
                    break
        return pairs

    rnd = random.Random(5)
    for _ in range(300):
        a, b = ([(i, rnd.choice("abcde")) for i in range(rnd.randint(0, 15))] for _ in range(2))
        c, d = list(a), list(b)
        assert (_match(a, b), a, b) == (scan(c, d), c, d)

from epochalis.llm import toxicity


def test_shouting_voter_reads_whole_texts():
    assert toxicity.patterns("a" * 5000 + "B" * 8000)[0]
    assert not toxicity.patterns("B" * 5000 + "a" * 8000)[0]

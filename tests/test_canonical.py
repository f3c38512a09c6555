from agentlake.functions.jsonsig import canonical_text


def test_keys_are_sorted_at_every_depth():
    one = '{"route":{"to":"Oslo","from":"Bergen","stops":[{"n":2,"at":"Voss"},{"n":1,"at":"Gol"}]},"adult":true,"cost":12.50}'
    two = '{"cost":12.50,"adult":true,"route":{"stops":[{"at":"Voss","n":2},{"at":"Gol","n":1}],"from":"Bergen","to":"Oslo"}}'
    want = '{"adult":true,"cost":12.50,"route":{"from":"Bergen","stops":[{"at":"Voss","n":2},{"at":"Gol","n":1}],"to":"Oslo"}}'
    assert canonical_text(one) == canonical_text(two) == want


def test_numbers_kept_as_written_and_invalid_passthrough():
    assert canonical_text('{"b":5.0,"a":1}') == '{"a":1,"b":5.0}'
    assert canonical_text("{oops") == "{oops"

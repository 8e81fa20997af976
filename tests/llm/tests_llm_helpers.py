"""Plain Python forms that several tests of this folder share."""

from test_packing import check_pieces
from test_secret_scan import all_spans
from test_simhash import plain_classes, plain_fingerprint


def spans_by_hand(text, ratios):
    """(start, stop) of the stretches that all spans cover."""
    out = []
    for a, _, b in all_spans(text, ratios):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


__all__ = ["check_pieces", "plain_classes", "plain_fingerprint", "spans_by_hand"]

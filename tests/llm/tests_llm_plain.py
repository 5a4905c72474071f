"""Plain versions shared by the tests of the pipeline."""

from test_contamination import plain as plain_contained
from test_line_dedup import plain as removed_by_row
from test_mixing import plain_targets
from test_near_copies import plain_kept


def plain_removed_lines(rows):
    return {row[0]: gone for row, gone in removed_by_row(rows).items()}


__all__ = ["plain_contained", "plain_kept", "plain_removed_lines", "plain_targets"]

import math

import pytest

from readloom.config import ConfigError, FilterConfig, LcaConfig, ReassignConfig, parse_size
from readloom.operators.kneedle import knee
from readloom.sources.sinks import output_names


def test_ranges():
    for make in (lambda: ReassignConfig(scale=1.5), lambda: ReassignConfig(mismatch_penalty=1), lambda: ReassignConfig(max_read_length=3), lambda: FilterConfig(trim_min=90, trim_max=10), lambda: FilterConfig(min_norm_gini=2), lambda: LcaConfig(rank="none")):
        with pytest.raises(ConfigError):
            make()
    assert FilterConfig(min_norm_entropy="None").min_norm_entropy is None
    assert FilterConfig(min_norm_entropy="0.5").min_norm_entropy == 0.5
    assert FilterConfig().max_read_length == math.inf


def test_sizes():
    assert parse_size("1M") == 1e6 and parse_size("2K", 1024) == 2048 and parse_size(5) == 5
    with pytest.raises(ConfigError):
        parse_size("x")


def test_names():
    assert output_names("/a/b.bam")["stats"] == "b_stats.tsv.gz"
    assert output_names("/a/b.bam", "p")["lca_summary"] == "p_lca-summary.tsv.gz"


def test_knee():
    x = [i / 10 for i in range(11)]
    assert knee(x, [1 - v**6 for v in x])[0] in (0.6, 0.7, 0.8)
    assert knee(x, [1.0] * 11) is None
    assert knee([0.1], [0.5]) is None

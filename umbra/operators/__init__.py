"""DataFrame operators: cleaning, profiling, Mondrian, DP mechanisms, reports."""

"""umbra: privacy-preserving data preparation on Spark DataFrames.

Every operator takes and returns DataFrames and runs on executors:
cleaning as column expressions, Mondrian partitioning as a level-by-level
loop over frequency-compressed tuples, and differential-privacy noise as
keyed column expressions that do not depend on physical partitioning.
"""

__version__ = "0.1.0"

"""Fixed values that results depend on.

These values must stay as they are for the statistics to mean the same thing
as the published pipeline they re-create.
"""

# ---- fixed values -----------------------------------------------------------
# Estimated average number of tokens in one document of the corpus.
TOKENS_PER_DOCUMENT = 4326
# Corpus size the published statistics were normalised with.
DEFAULT_TOTAL_DOCUMENTS = 16023367
# Default number of top co-occurring words kept per term.
DEFAULT_TOP_N = 1000000
# Maximum number of fragments kept per (term, document); none unless a caller sets it.
DEFAULT_FRAGMENT_LIMIT = None
# Words added to the English stop-word list.
EXTRA_STOP_WORDS = ("fig", "et", "al", "eg")
# Words dropped by token cleaning when no list is given.
DEFAULT_UNWANTED_WORDS = ("httpdoc", "example")
# Splits an author string into names: ';', ', and ', ' and ', '|'.
AUTHOR_SEPARATOR = r";|, and | and |\|"
# Bibliography collection defaults.
BIBJSON_VERSION = "0.2"
DEFAULT_COLLECTION = "termlens-collection"
BIBJSON_GENERATOR = "termlens (bibliography job)"
# Neighbour search defaults: number of trees and neighbours (self included).
DEFAULT_TREES = 10
DEFAULT_NEIGHBOURS = 10
# Fragment boundaries used when cutting documents into snippets: sentence marks
# before white space or the end (so "3.5" and "u.s" stay whole), and line ends.
FRAGMENT_SPLIT = r"[.!?]+(?:[\t-\r ]+|\z)|\n+"
# -----------------------------------------------------------------------------

# Search terms used by the registered queries on the driver tables.  They are
# parameters (any list works); these occur in every scale factor of the data.
DEFAULT_TERMS = ("thble", "thing", "thtion", "nicht", "retion", "onble", "of the")
# total_docs used by the registered queries; the published corpus size.
QUERY_TOTAL_DOCS = DEFAULT_TOTAL_DOCUMENTS

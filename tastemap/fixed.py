"""Behaviour the results share with the reference service.

They are stated once, here, and imported where used.
"""

# Fixed values (reference defaults and API choices).
ALS_FACTORS = 30                 # latent factors
ALS_ITERATIONS = 30              # ALS iterations
ALS_REGULARIZATION = 0.1         # lambda; the fold-in penalty is n * lambda
MIN_RATINGS = 1000               # rows per item (rated or not) to enter training
RECOMMEND_N_API = 100            # recommendations per user, as the service asks
SIMILAR_N_API = 20               # similar items per item, as the service asks
SEARCH_N = 10                    # titles per search text
SEARCH_MIN_CHARS = 1             # shortest search text the server accepts (after strip)
SEARCH_MIN_CHARS_CLIENT = 2      # shortest search text the browser sends
PAGE_SIZE = 20                   # report rows per page
LIST_PAGE_ENTRIES = 1000         # entries per user-list page requested
SCORE_DIGITS = 2                 # predicted score and average in reports
SIMILARITY_DIGITS = 3            # similarity in reports
MISSING_SCORE_TEXT = "N/A"       # average rating shown when unknown
PLACEHOLDER_TITLE = "Item {}"    # title of an item missing from the catalogue
QUOTA_WINDOW = "1 hour"          # fixed quota windows
QUOTAS = (("recommendations", 30), ("similar", 60), ("search", 1000))  # calls per window

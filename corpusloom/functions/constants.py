"""Fixed values of the retrieval engine."""

# Words left out of the index and of queries.
STOP = """
a an and are as at be by for from has have in is it its of on or that the their this to was were with without within into
between over under than then thus hence therefore however not nor but if else when where while whom whose which who what why
how can may might must shall should will would could do does did done also such many most more some any each per via using
used study studies paper papers result results method methods approach approaches technique techniques model models data
dataset datasets system systems figure figures table tables appendix references introduction conclusion conclusions
yes no true false
design value values vsd privacy security fairness bias harms trust governance regulation policy stakeholders stakeholder users
user participants participant actors actor
""".split()

# Phrases by which a passage answers or defines.
ANSWER_PATTERNS = [" is a ", " we define ", " we propose ", " we argue ", " consists of ", " stakeholders include ", " method ", " methodology "]

# Token, rerank-token, white-space and doi patterns.
TOKEN = "[A-Za-z0-9]+"
RERANK_TOKEN = "[a-z0-9_]+(?:-[a-z0-9_]+)?"
SPACE = r"[\p{Z}\t-\r\x1c-\x1f\x{85}]+"
DOI = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ["Dr", "Mr", "Mrs", "Ms", "Prof", "vs", "etc", r"i\.e", r"e\.g", "cf", "al"]
SECTIONS = ["result", "conclusion", "summary", "discussion"]
QUALITY_WARNING = "[TEXT_QUALITY_WARNING] "

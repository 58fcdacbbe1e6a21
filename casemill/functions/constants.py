"""The words, codes and labels that results depend on."""

#: Roster keys in order of seat.
ROSTER = ("macdonald", "donovan", "hantz_marconi", "bassett", "hicks", "countway", "gould", "will", "lynn")
#: Display names.
DISPLAY = {
    "macdonald": "MacDonald, C.J.", "donovan": "Donovan, J.", "hantz_marconi": "Hantz Marconi, J.", "bassett": "Bassett, J.",
    "hicks": "Hicks, J.", "countway": "Countway, J.", "gould": "Gould, J.", "will": "Will, J.", "lynn": "Lynn, C.J.",
    "per_curiam": "Per Curiam",
}
#: Votes that count as taking part, and those that do not.
PARTICIPATING = ("majority", "dissent", "concur_separate")
ABSENT = ("not_participating", "recused", "disqualified")
#: Outcome labels.
OUTCOME_LABELS = {
    "affirmed": "Affirmed", "reversed": "Reversed", "remanded": "Remanded", "reversed_and_remanded": "Reversed & Remanded",
    "vacated": "Vacated", "dismissed": "Dismissed", "affirmed_and_remanded": "Affirmed & Remanded",
}
#: Column order of the outcome pivot.
OUTCOME_ORDER = ("Affirmed", "Remanded", "Affirmed & Remanded", "Reversed & Remanded", "Reversed", "Vacated", "Dismissed")
#: Misspelled outcomes.
OUTCOME_REPAIR = {"remaned": "remanded"}
#: Words in a caption that make it a family case.
FAMILY_WORDS = ("domestic violence", "divorce", "custody", "parenting", "parental rights", "child support", "visitation", "marital", "adoption")
#: Statute chapters of family and of criminal law.
FAMILY_CHAPTERS = ("458", "461-a", "170-c", "169-c", "173-b")
CRIMINAL_CHAPTERS = (
    "318-b", "625", "626", "627", "628", "629", "630", "631", "632", "633", "634", "635", "636", "637", "638",
    "639", "640", "641", "642", "643", "644", "645", "646", "647", "648", "649", "650", "651",
)
#: The spellings of the three case types.
CASE_TYPE_LABELS = {
    "criminal": "Criminal", "civil": "Civil", "family": "Family/Domestic", "domestic": "Family/Domestic",
    "family/domestic": "Family/Domestic", "domestic/family": "Family/Domestic",
}
FAMILY_TYPES = ("family/domestic", "domestic/family", "family", "domestic")
#: Words that a description search leaves out.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "had", "has", "have", "he", "her", "his", "in", "into", "is", "it",
    "its", "of", "on", "or", "she", "that", "the", "their", "them", "to", "was", "were", "with",
)
#: Order of the seats on the bench.
BENCH_ORDER = ("macdonald", "donovan", "hantz_marconi", "countway", "gould", "will", "bassett", "hicks", "lynn")
#: Patterns that decide what a field is or where it ends.
QUOTES = "[\\]\\[(){}\"'“”‘’`]+"
JUDGE = "\\([A-Za-z\\s.'‘’-]+,\\s*(?:C\\.J\\.|JJ\\.|J\\.)\\)"
JUDGE_NAME = "\\(([A-Za-z\\s.'‘’-]+),\\s*(?:C\\.J\\.|JJ\\.|J\\.)\\)"
INITIALS = "^[A-Z]\\.[A-Z]\\.\\s+v\\.\\s+[A-Z]\\.[A-Z]\\."
STATE_V = "^state(?:\\s+of\\s+{state})?\\s+v\\.\\s+"
CASE_MARKER = "(?is)(?:Case\\s*No\\.?|Citation\\s*:|Order\\s*No\\.?|\\bNo\\.\\s*\\d{4}|\\d{4}-\\d{4}).*$"
SUPERIOR_COURT = "^(?:[A-Z][A-Za-z]*(?:\\s+[A-Z][A-Za-z]*)*\\s+)?Superior\\s+Court(?:\\s+{judge})?"
FEDERAL_COURT = "(?i)u\\.?s\\.?\\s+district\\s+court"
FAMILY_CITATION, CRIMINAL_CITATION = "(?i)^RSA\\s+(?:169-C|173-B|458|461-A)", "(?i)^RSA\\s+(?:6\\d{2}|265-A)"
AUTHOR_LINE = "(?m)^(?:PER CURIAM|[A-Z][A-Z\\-]+(?:\\s+[A-Z][A-Z\\-]+)?,\\s+(?:C\\.J\\.|J\\.))[.\\s]"
SECTION_HEADING = (
    "(?m)^[ \\t]*(?:I\\.?\\s+)?(?:Background|Facts|BACKGROUND|FACTS|Discussion|DISCUSSION|Procedural History|Procedural|PROCEDURAL"
    "|History|HISTORY|Analysis|ANALYSIS|The Facts|The Background)\\s*$"
)
CITATION = "(RSA\\s+[\\d\\-A-Z:]+)"
CITATION_IN_TEXT = "(RSA\\s+[\\d\\-A-Z:]+(?:,?\\s+[IVX]+)?)"
REPORTER = "(?i)\\b((\\d{4})\\s+N\\.H\\.\\s+(\\d+))\\b"
#: Labels of court types, first match first.
COURT_TYPES = {
    "family": "Circuit Court – Family Division", "district": "Circuit Court – District Division", "probate": "Circuit Court – Probate Division",
    "circuit": "Circuit Court", "superior": "Superior Court", "probate alone": "Probate Court",
}
#: Reasons for a case type.
REASONS = (
    "state_v_case_name", "family_keyword_case_name", "family_rsa_marker", "criminal_rsa_marker", "initials_case_name_pattern", "insufficient_signals",
    "default_state_v_caption", "default_in_the_matter_of", "default_initials_pattern", "default_v_state_caption", "default_fallback_civil",
    "topic_based", "existing_case_type",
)
#: Column order of the flat case table.
FLAT_COLUMNS = (
    "case_number", "citation", "citation_year", "citation_seq", "case_name", "pdf_url", "date_argued", "date_issued",
    "days_to_decision", "term_year", "lower_court", "lower_court_type", "lower_court_judge", "case_type", "appeal_type",
    "outcome", "author", "author_display", "majority", "dissent", "concur_separate", "not_participating", "vote_string",
    "is_unanimous", "has_dissent", "has_separate_concurrence", "topics", "rsa_citations", "rsa_primary",
    "involves_statutory_interpretation", "standard_of_review", "summary_paragraph", "word_count", "opinion_type",
    "parse_version", "parse_timestamp", "parse_confidence",
)

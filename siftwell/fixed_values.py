"""Values that are part of the data formats and so must stay as they are.

Fixed values: changing any of these changes which files can be read, what the
model is asked, or which answers count as valid.
"""

# Archive files: a script assignment around one JSON array of wrapper objects.
ARCHIVE_SUFFIX = ".js"
ARCHIVE_GLOB = "*.[jJ][sS]"

# Ids.
UNKNOWN_ID = "unknown"

# Answers of the model.
CODE_FENCES = ["```json", "```"]
ANSWER_OBJECT_PATTERN = r"(?s)\{.*\}"
REQUIRED_KEYS = ["explicit_words", "reason_for_flag", "topic_of_tweet", "deletion"]
DELETE = "DELETE"
KEEP = "KEEP"
NOT_DECIDED = "N/A"

# Errors of the model service that are worth another attempt.
RATE_LIMIT_MARKERS = ["RESOURCE_EXHAUSTED", "429"]

# Reports.
REPORT_FIELDS = ["tweet_url", "deletion"]
CHUNK_REPORT_GLOB = "*_chunk_*.csv"
MERGED_REPORT = "merged_report.csv"

# The prompt. {criteria} and {tweet_text} mark where values go.
CRITERIA_TEMPLATE = (
    "Forbidden words: {forbidden_words}\n"
    "Topics to exclude: {topics_to_exclude}\n"
    "Tone requirements: {tone_requirements}\n"
    "Additional instructions: {additional_instructions}"
)
PROMPT_TEMPLATE = """
        Analyze this tweet and determine if it should be flagged for deletion.

        Tweet: "{tweet_text}"

        Criteria for flagging
        {criteria}

        CRITICAL INSTRUCTIONS:
        1. Respond ONLY with valid JSON - no markdown, no code blocks, no explanations
        2. Do NOT wrap your response in ```json or ``` tags
        3. Use double quotes for all strings
        4. Ensure "deletion" is EXACTLY either "DELETE" or "KEEP" (all caps)
        5. If no explicit words found, use empty array []
        6. All arrays must be properly formatted


        Example of VALID response:
        {
        "explicit_words": ["damn"],
        "reason_for_flag": "Contains mild profanity",
        "topic_of_tweet": ["complaint", "frustration"],
        "deletion": "DELETE"
        }

        Example of VALID response (no issues):
        {
        "explicit_words": [],
        "reason_for_flag": "Tweet is clean and appropriate",
        "topic_of_tweet": ["technology", "news"],
        "deletion": "KEEP"
        }

        Now analyze the tweet above and respond with ONLY the JSON object
        """

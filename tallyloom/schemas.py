"""Row types of the logical tables, as DDL."""

VISIT = "url string, title string, time timestamp, visit_count int, domain string"
SEARCH = "query string, time timestamp, engine string"
PROMPT = "prompt string, time timestamp, project string, is_opener boolean, conversation_file string, turn_count int"
COMMIT = "hash string, message string, time timestamp, repo string, files_changed int, insertions long, deletions long, file_paths array<string>"
EVENT = "seq long, time timestamp, source string, activity_type string, topics array<string>, entities array<string>, intent string, confidence double, category string, summary string"
TOPIC_STATE = "topic string, first_seen date, last_seen date, day_count long, recent_days array<date>"
COST = "provider string, persona string, tier string, input_tokens long, output_tokens long, cost double, response_ms long"

"""The schema of every relation, as Spark DDL. Readers use these; nothing is inferred."""

ACTS = "category string, filename string, description string, urls array<string>"
RAW = "path string, category string, text string"
SECTION = "category string, act_name string, year int, chapter string, section_number string, section_title string, topics array<string>, text string, citation string, char_count int, short_name string, ministry string"
CHUNK = "text string, citation string, section_number string, section_title string, chapter string, act_name string, short_name string, year int, category string, source string, chunk_index int, chunk_id string, total_chunks int"
VECTOR = "id string, document string, embedding array<float>, metadata struct<citation:string,section_number:string,section_title:string,chapter:string,act_name:string,topics:array<string>,short_name:string,year:int,category:string,source:string,chunk_index:int,total_chunks:int,chunk_id:string>"
INTENT = "intent string, category string, anchors array<string>, prototype string, examples array<string>"
PROTOTYPE = "category string, prototype string"
TOPIC = "topic string, keywords array<string>"
CONTEXT = "query_id bigint, original_query string, expanded_query string, intents array<string>, category string, confidence double, anchors array<string>"
CASE = "query_id bigint, query string, primary array<struct<act:string,section:string>>, secondary array<struct<act:string,section:string>>, category_filter string, notes string"
MANIFEST = "file_key string"
POSTING = "doc string, term string, tf bigint"

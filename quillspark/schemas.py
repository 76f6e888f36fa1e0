"""Schemas of stored tables. Order is explicit: cue_idx, seg_idx, chunk_index."""

VIDEOS = (
    "video_id string, title string, url string, playlist_ids array<string>, playlist_titles array<string>, channel string, "
    "upload_date string, duration int, description string, is_recipe boolean, skip_reason string"
)
CUES = "video_id string, cue_idx int, text string, start double, duration double"
SPAN = "struct<start:double,end:double>"
SEGMENT = "struct<text:string,start:double,end:double,timecode:string,url:string>"
TRANSCRIPT = (
    f"meta struct<video_id:string,title:string,url:string,playlist_ids:array<string>,playlist_titles:array<string>,channel:string,upload_date:string,"
    f"duration:int,description:string,is_recipe:boolean,skip_reason:string>, language string, is_generated boolean, source string, "
    f"punctuation_backend string, raw_cues_count int, removed_ad_spans array<{SPAN}>, segments array<{SEGMENT}>"
)
CHUNKS = (
    "chunk_id string, video_id string, title string, url string, timecode string, start double, end double, chunk_index int, n_chunks int, "
    "section string, has_ingredients boolean, has_steps boolean, char_len int, token_len int, playlist_ids array<string>, "
    "playlist_titles array<string>, text string"
)
GOLDEN = "id string, query string, relevant array<string>, kind string, expect_found boolean, note string"
SOURCE = "struct<n:int,video_id:string,title:string,url:string,timecode:string>"

"""The tables of a video, with the types of their columns. Every table has ``video_id`` first, by which it is partitioned."""

from __future__ import annotations

from pyspark.sql.types import StructType

#: Table name -> DDL of its columns behind video_id.
TABLES = {
    "video_meta": "filename string, storage_path string, duration double, width int, height int, fps double, codec string, file_size long, status string",
    "shot": "scene_index int, start_time double, end_time double, duration double, keyframe_paths array<string>, beat_index int, story_scene_index int",
    "beat": "beat_index int, start_time double, end_time double, duration double, shot_indices array<int>, beat_type string, description string, emotion string, intensity double, characters array<string>",
    "story_scene": "story_scene_index int, start_time double, end_time double, duration double, beat_indices array<int>, shot_indices array<int>, location string, description string, characters array<string>, plot_function string",
    "chapter": "chapter_index int, title string, start_time double, end_time double, duration double, story_scene_indices array<int>, beat_indices array<int>, shot_indices array<int>, description string, chapter_type string, theme string, characters array<string>",
    "minute_chunk": "chunk_index int, shot_indices array<int>, start_time double, end_time double, duration double",
    "transcript": "pos int, start_time double, end_time double, text string, speaker string, confidence double, scene_index int, character_id string, cross_shot boolean",
    "ocr": "scene_index int, timestamp double, texts array<string>",
    "vision": "scene_index int, timestamp double, description string, objects array<string>, mood string, scene_type string, action_description string",
    "audio_prosody": "scene_index int, has_music boolean, music_mood string, has_sfx boolean, sfx_tags array<string>, silence_ratio double, speech_rate double, volume_peak double, speech_emotion string",
    "character": "character_id string, display_name string, description string, appearance_scenes array<int>, total_screen_time double, speaker_ids array<string>, role string, importance_score double",
    "character_profile": "character_id string, names array<string>, description string, tier string, is_human boolean, entity_type string, merged_into string",
    "character_gallery": "character_id string, total_detections int, appearance_scenes array<int>, tier string, embedding_centroid array<double>, faces array<struct<path: string, timestamp: double, scene_index: int>>",
    "character_arc": "character_id string, arc_type string, description string, key_moments array<int>",
    "character_relation": "character_a string, character_b string, relation_type string, description string, strength double, co_appearance_shots array<int>",
    "event": "event_index int, start_time double, end_time double, event_type string, description string, characters array<string>, emotion string, importance int, scene_indices array<int>, confidence double",
    "event_edge": "source int, target int, relation_type string, description string, strength double, confidence double",
    "alignment": "scene_index int, speaker_to_character map<string, string>, visible_characters array<string>, speaking_characters array<string>, active_modalities array<string>, dominant_modality string, alignment_confidence double, notes string",
    "edit_signal": "unit_type string, unit_index int, scores map<string, double>, suggested_usage array<string>",
    "memory_unit": "scene_index int, start_time double, end_time double, combined_text string, characters array<string>, embedding array<double>",
    "edit_plan": "plan_id string, target_duration double, status string, bgm_enabled boolean, bgm_path string",
    "edit_clip": "plan_id string, clip_index int, source_scene_index int, source_start double, source_end double, timeline_start double, timeline_end double, narrative_role string, characters array<string>, evidence_refs array<string>, speed double, audio_volume double, transition_in string, transition_out string",
    "review_result": "plan_id string, approved boolean, score double, feedback string, issues array<string>",
    "text_index": "scene_index int, combined_text string, transcript string, vision_description string, characters array<string>, keywords array<string>",
    "vector_index": "scene_index int, embedding array<float>",
    "character_index": "character string, unit_type string, unit_index int",
    "event_index": "event_type string, event_ids array<long>",
    "relation_index": "relation_key string, character_a string, character_b string, relation_type string, description string, strength double, co_appearance_shots array<int>",
    "emotion_index": "emotion string, source string, ref long, intensity double",
    "signal_index": "signal string, rank int, unit_type string, unit_index int, score double",
    "audio_index": "tag string, scene_index int, volume_peak double",
    "chapter_index": "chapter_key string, chapter_index int, title string, description string, theme string, chapter_type string, characters array<string>",
    "usage_index": "tag string, unit_type string, unit_index int",
    "progress": "step string, at timestamp",
}


#: Tables that are built from others and may be built again.
INDEXES = tuple(name for name in TABLES if name.endswith("_index"))


def schema(name: str) -> StructType:
    return StructType.fromDDL(f"video_id string, {TABLES[name]}")

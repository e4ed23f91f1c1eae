"""Values that results depend on, stated once.

Every entry below is a FIXED VALUE of the data model: names, word lists, bounds
and formats that stored tables and published results already use.  Code derives
its expressions from these constants instead of repeating them.
"""

# Fixed value: the order of the numeric features inside a feature vector.
FEATURES = (
    "danceability",
    "bpm",
    "loudness_integrated",
    "loudness_range",
    "spectral_rms",
    "spectral_centroid",
    "spectral_flux",
    "pitch_salience",
    "hfc",
    "zcr",
    "onset_rate",
    "key_strength",
)
VECTOR_DIM = len(FEATURES)
TEXT_DIM = 768

# Labels written into the mart and the flattened rows.  The profile label is a
# parameter of the operators; this is only its default.
VECTOR_PROFILE = "audio_v1"
FEATURES_VERSION = "essentia_music_v1"

# Fixed value: genres that carry no music and are dropped in staging.
EXCLUDED_GENRES = ("Comedy", "Books & Spoken")

# Fixed value: audio file types that are listed, and the protected one that never is.
AUDIO_EXTENSIONS = ("mp3", "m4a", "flac", "wav", "aiff", "aif")
PROTECTED_EXTENSIONS = ("m4p",)

# Fixed value: marker of a lookup that has to be tried again.
RETRY_MARKER = "RETRY"

# Image size tokens in artwork addresses.
ART_SIZE_FOUND = "100x100bb"
ART_SIZE_WANTED = "600x600bb"

# Fixed value: key estimators in order of preference.
KEY_BLOCKS = ("tonal.key_edma", "tonal.key_krumhansl", "tonal.key_temperley")

# Bucket labels as (exclusive upper bound, label); None = no bound.
TEMPO_BUCKETS = (
    (65, "very slow"),
    (85, "slow"),
    (105, "moderate tempo"),
    (125, "upbeat"),
    (145, "fast"),
    (None, "very fast"),
)
ENERGY_BUCKETS = (
    (-20, "very quiet and intimate"),
    (-17, "quiet and gentle"),
    (-14, "moderate energy"),
    (-11, "energetic"),
    (None, "loud and driving"),
)
GROOVE_BUCKETS = (
    (1.0, "low groove"),
    (1.1, "moderate groove"),
    (1.2, "groovy"),
    (1.35, "danceable"),
    (None, "highly danceable"),
)
DYNAMICS_BUCKETS = (
    (4.0, "compressed, consistent sound"),
    (8.0, "moderate dynamics"),
    (None, "wide dynamic range"),
)
SCALE_MOODS = (
    ("minor", "darker and more melancholic"),
    ("major", "brighter and more uplifting"),
)

# Defaults shown for missing metadata.
UNKNOWN_TITLE = "Unknown Title"
UNKNOWN_ARTIST = "Unknown Artist"
UNKNOWN_ALBUM = "Unknown Album"
UNKNOWN_YEAR = "unknown year"
UNKNOWN_GENRE = "Unknown Genre"
UNKNOWN_LABEL = "Unknown"
DASH = "\u2014"

# Fixed value: characters treated as white space when text is stripped or collapsed.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular-expression class understood by Java and RE2.
WHITESPACE_CLASS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Sampling and retrieval sizes.
SAMPLE_FLOOR = 0.01          # weight given to the weakest remaining candidate
FETCH_FACTOR_TEXT = 5        # text retrieval reads min(5k, 50) candidates
FETCH_LIMIT_TEXT = 50
FETCH_FACTOR_AUDIO = 3       # audio retrieval reads 3k + 1 candidates
SUPPORTING_CARDS = 5

# The flattened feature row, in order, with Spark types.
FLAT_COLUMNS = (
    ("artist", "string"), ("album", "string"), ("title", "string"), ("date", "string"),
    ("genre", "string"), ("genre_csv", "string"), ("albumartist", "string"),
    ("composer", "string"), ("tracknumber", "bigint"), ("discnumber", "bigint"),
    ("file_name", "string"),
    ("duration_sec", "double"), ("sample_rate", "double"), ("bit_rate", "double"),
    ("channels", "double"), ("codec", "string"), ("lossless", "boolean"),
    ("replay_gain", "double"),
    ("bpm", "double"), ("danceability", "double"), ("onset_rate", "double"),
    ("beats_count", "double"), ("bpm_peak1", "double"), ("bpm_peak2", "double"),
    ("key_key", "string"), ("key_scale", "string"), ("key_strength", "double"),
    ("tuning_frequency", "double"), ("equal_tempered_deviation", "double"),
    ("chords_changes_rate", "double"),
    ("loudness_integrated", "double"), ("loudness_range", "double"),
    ("avg_loudness", "double"), ("dyn_complexity", "double"),
    ("spectral_rms", "double"), ("spectral_centroid", "double"), ("spectral_flux", "double"),
    ("spectral_spread", "double"), ("pitch_salience", "double"), ("hfc", "double"),
    ("zcr", "double"),
    ("mfcc_mean", "array<double>"), ("thpcp", "array<double>"),
    ("voice_instrumental_value", "string"), ("voice_instrumental_prob_vocal", "double"),
    ("voice_instrumental_prob_instrumental", "double"),
    ("mood_happy", "double"), ("mood_relaxed", "double"), ("mood_party", "double"),
    ("mood_model", "string"), ("mood_version", "string"),
    ("features_version", "string"), ("essentia_version", "string"),
    ("extracted_with", "string"), ("source_path", "string"), ("file_hash", "string"),
    ("json_path", "string"), ("extracted_at", "string"),
)

# The typed staging row; "rounded" columns are whole numbers.
STAGED_WHOLE = {
    "tracknumber": "int", "discnumber": "int", "sample_rate": "bigint", "bit_rate": "bigint",
    "channels": "bigint", "beats_count": "bigint", "bpm_peak1": "bigint", "bpm_peak2": "bigint",
}

# Where each plain number or string of a feature document is found.
DOCUMENT_PATHS = {
    "bpm": "rhythm.bpm",
    "danceability": "rhythm.danceability",
    "onset_rate": "rhythm.onset_rate",
    "beats_count": "rhythm.beats_count",
    "bpm_peak1": "rhythm.bpm_histogram_first_peak_bpm",
    "bpm_peak2": "rhythm.bpm_histogram_second_peak_bpm",
    "tuning_frequency": "tonal.tuning_frequency",
    "equal_tempered_deviation": "tonal.tuning_equal_tempered_deviation",
    "chords_changes_rate": "tonal.chords_changes_rate",
    "loudness_integrated": "lowlevel.loudness_ebu128.integrated",
    "loudness_range": "lowlevel.loudness_ebu128.loudness_range",
    "avg_loudness": "lowlevel.average_loudness",
    "dyn_complexity": "lowlevel.dynamic_complexity",
    "spectral_rms": "lowlevel.spectral_rms.mean",
    "spectral_centroid": "lowlevel.spectral_centroid.mean",
    "spectral_flux": "lowlevel.spectral_flux.mean",
    "spectral_spread": "lowlevel.spectral_spread.mean",
    "pitch_salience": "lowlevel.pitch_salience.mean",
    "hfc": "lowlevel.hfc.mean",
    "zcr": "lowlevel.zerocrossingrate.mean",
    "mfcc_mean": "lowlevel.mfcc.mean",
    "thpcp": "tonal.thpcp",
    "duration_sec": "metadata.audio_properties.length",
    "sample_rate": "metadata.audio_properties.sample_rate",
    "bit_rate": "metadata.audio_properties.bit_rate",
    "channels": "metadata.audio_properties.number_channels",
    "codec": "metadata.audio_properties.codec",
    "lossless": "metadata.audio_properties.lossless",
    "replay_gain": "metadata.audio_properties.replay_gain",
    "file_hash": "metadata.audio_properties.md5_encoded",
    "essentia_version": "metadata.version.essentia",
    "extracted_with": "metadata.version.extractor",
}
# Tags hold one string or a list of strings.
TAGS_PATH = "metadata.tags"
STRING_TAGS = ("artist", "album", "title", "date", "genre", "albumartist", "composer", "file_name")
NUMBER_TAGS = ("tracknumber", "discnumber")

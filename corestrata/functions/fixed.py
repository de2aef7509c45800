"""What identities, formats and published algorithms prescribe. Names and domains are this engine's own, so its identities are not those of other programs."""

# Domains of digests.
PROFILE_DOMAIN = b"corestrata.profile.v1\0"
MANIFEST_DOMAIN = b"corestrata.manifest.v1\0"
SEQUENCE_DOMAIN = b"corestrata.chunk-sequence.v1\0"
# Hash suites.
SHA256_SUITE = "corestrata.sha256.v1"
BLAKE3_SUITE = "corestrata.blake3-256.v1"
# The chunking algorithm and its registered profile.
ALGORITHM = "corestrata.gear.v1"
STABLE_PROFILE = "corestrata.gear.v1.64k"
GEAR_TABLE = "corestrata.gear-table.v1"
GEAR_SHA256 = "91a3061015ae351cd3701852712bcd6aa4a1ce26c8a231d3969432b00f028f88"
# Masks by number of bits, from 5 on.
MASKS = (
    0x0000000001804110,
    0x0000000001803110,
    0x0000000018035100,
    0x0000001800035300,
    0x0000019000353000,
    0x0000590003530000,
    0x0000D90003530000,
    0x0000D90103530000,
    0x0000D90303530000,
    0x0000D90313530000,
    0x0000D90F03530000,
    0x0000D90303537000,
    0x0000D90703537000,
    0x0000D90707537000,
    0x0000D91707537000,
    0x0000D91747537000,
    0x0000D91767537000,
    0x0000D93767537000,
    0x0000D93777537000,
    0x0000D93777577000,
    0x0000DB3777577000,
)
# Similarity features.
RABIN_POLYNOMIAL = 0x003DA3358B4DC173
TRANSFORM_LABEL = "corestrata.feature-map/"
SUPER_FEATURE_DOMAIN = "corestrata.super-feature.v1"
STRIDE_DOMAIN = "corestrata.stride.v1"
# The zstd dictionary magic, which raw dictionaries must not begin with.
ZSTD_DICTIONARY_MAGIC = bytes.fromhex("37a430ec")
# The domain of tree identities.
TREE_DOMAIN = b"corestrata.tree.v1\0"
# Dictionary envelopes, each nested in the next: name, most references, most bytes of the dictionary, bits of the window.
ENVELOPES = (
    ("refs4-1m", 4, 1 << 20, 20),
    ("refs64-1m", 64, 1 << 20, 20),
    ("refs256-4m", 256, 4 << 20, 23),
    ("refs512-8m", 512, 8 << 20, 24),
    ("refs2048-32m", 2048, 32 << 20, 26),
)

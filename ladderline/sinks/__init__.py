"""Writers for the match table and for sharded JSON documents."""

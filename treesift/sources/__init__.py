"""Where entries come from and go to: listings, snapshots, exports."""

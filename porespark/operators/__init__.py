"""DataFrame operators on voxels, bodies, throats, edges, paths and runs."""

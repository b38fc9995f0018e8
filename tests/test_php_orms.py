"""Laravel migrations and models, and Doctrine entities."""

import pytest
from building import build

from tessera.parsers import parse_file, php_orms

MIGRATION = r"""<?php

use Illuminate\Database\Migrations\Migration;
use Illuminate\Database\Schema\Blueprint;
use Illuminate\Support\Facades\Schema;

return new class extends Migration {
    // builds all tables
    public function up(): void
    {
        Schema::create('members', function (Blueprint $table) {
            $table->id();
            $table->string('name', 100);
            $table->unsignedTinyInteger('level')->default(1);
            $table->string('email')->unique()->nullable()->comment("the user's");
            $table->enum('state', ['on', 'off'])->default('on');
            $table->timestamps();
            $table->index(['name', 'level'], 'by_name');
        });
        Schema::create('notes', function (Blueprint $table) {
            $table->uuid('id')->primary();
            $table->foreignId('member_id')->constrained()->cascadeOnDelete();
            $table->foreignId('editor_id')->nullable()->constrained('members');
            $table->unsignedBigInteger('team_id');
            $table->foreign('team_id')->references('id')->on('teams')->onDelete('set null');
            $table->morphs('subject');
        });
        Schema::table('members', function (Blueprint $table) {
            $table->string('phone')->nullable();
            $table->string('name', 150)->change();
            $table->dropColumn(['a', 'b']);
            $table->renameColumn('c', 'd');
        });
        Schema::dropIfExists('old');
    }

    public function down(): void
    {
        Schema::dropIfExists('members');
    }
};
"""

MODEL = r"""<?php
namespace App\Models;
use Illuminate\Database\Eloquent\Model;

final class Note extends Model
{
    protected $table = 'notes';

    public function author(): BelongsTo
    {
        return $this->belongsTo(\App\Models\Member::class, 'member_id');
    }
    public function replies() { return $this->hasMany(Reply::class); }
    public function tags() { return $this->belongsToMany(Tag::class)->withTimestamps(); }
    public function cover() { return $this->hasOne(Cover::class, 'of_id'); }
}
"""

ATTRIBUTES = r"""<?php
namespace App\Entity;
use Doctrine\ORM\Mapping as ORM;

#[ORM\Entity]
#[ORM\Table(name: 'accounts', schema: 'auth')]
#[ORM\Index(columns: ['email'], name: 'by_email')]
class Account extends Base
{
    #[ORM\Id, ORM\GeneratedValue]
    #[ORM\Column(type: 'integer')]
    private int $id;

    #[ORM\Column(type: 'string', length: 180, unique: true, options: ['default' => 'x', 'comment' => 'login'])]
    private string $email;

    #[ORM\Column(name: 'full_name', nullable: true)]
    private ?string $fullName = null;

    #[ORM\ManyToOne(targetEntity: Org::class, inversedBy: 'users')]
    #[ORM\JoinColumn(name: 'org_ref', referencedColumnName: 'id', nullable: false, onDelete: 'CASCADE')]
    private Org $org;

    #[ORM\ManyToMany(targetEntity: Role::class)]
    #[ORM\JoinTable(name: 'account_roles')]
    private Collection $roles;

    public function getId(): int { return $this->id; }
}

#[ORM\MappedSuperclass]
abstract class Base
{
    #[ORM\Column(type: 'datetime')]
    protected \DateTime $createdAt;
}
"""

ANNOTATIONS = r"""<?php
use Doctrine\ORM\Mapping as ORM;

/**
 * Something sold.
 * @ORM\Entity
 * @ORM\Table(name="goods", indexes={@ORM\Index(name="i", columns={"name"})})
 */
class Good
{
    /**
     * @ORM\Id
     * @ORM\GeneratedValue
     * @ORM\Column(type="integer")
     */
    private $id;

    /** @ORM\Column(type="string", length=255, nullable=true) */
    private $name;

    /**
     * @ORM\ManyToOne(targetEntity="App\Entity\Shelf")
     * @ORM\JoinColumn(name="shelf_id", referencedColumnName="id")
     */
    private $shelf;
}
"""


def names(e):
    return [c.name for c in e.columns]


def test_migration():
    (p,) = [x for x in parse_file("database/migrations/1.php", MIGRATION) if x.kind == "laravel"]
    members, notes, more = p.entities
    assert p.origin == "migration" and members.source.line == 10
    assert names(members) == ["id", "name", "level", "email", "state", "created_at", "updated_at"] and names(notes) == ["id", "member_id", "editor_id", "team_id", "subject_id", "subject_type"]
    of = {c.name: c for c in members.columns}
    assert (of["id"].type, of["id"].generated, of["level"].type, of["level"].default, of["email"].unique, of["email"].nullable, of["email"].comment) == ("bigint", True, "tinyint", "1", True, True, "the user's")
    assert (of["state"].enum_ref, p.enums[0].values, members.indexes[0].columns) == ("members_state", ["on", "off"], ["name", "level"])
    assert notes.columns[0].primary_key and (more.partial, names(more)) == (True, ["phone"])
    assert [(r.from_columns, r.to.name, r.on_delete, r.optional) for r in p.relations] == [(["member_id"], "members", "cascade", False), (["editor_id"], "members", None, True), (["team_id"], "teams", "set null", None)]
    assert [(o.op, o.column or o.table.name) for o in p.ops] == [("alterColumn", "name"), ("dropColumn", "a"), ("dropColumn", "b"), ("renameColumn", "c"), ("dropTable", "old")]


def test_eloquent():
    p = php_orms.laravel("app/Models/Note.php", MODEL)
    (note,) = p.entities
    assert (note.name, note.model_name, note.name_certainty, note.columns) == ("notes", "Note", 2, [])
    links = [(r.from_.model, r.to.model, r.from_columns, r.to_columns, r.cardinality, r.through and r.through.name) for r in p.relations]
    assert links == [
        ("Note", "Member", ["member_id"], [], "many-to-one", None),
        ("Note", "Reply", [], ["note_id"], "one-to-many", None),
        ("Note", "Tag", [], [], "many-to-many", "note_tag"),
        ("Cover", "Note", ["of_id"], [], "one-to-one", None),
    ]
    schema = build([php_orms.laravel("m.php", MIGRATION), p])
    assert ("notes", "members") in {(r["from"], r["to"]) for r in schema["relations"]}


def test_attributes():
    (p,) = [x for x in parse_file("src/Entity/Account.php", ATTRIBUTES) if x.kind == "doctrine"]
    account, base = p.entities
    assert (account.name, account.schema, account.extends, base.abstract) == ("accounts", "auth", ["Base"], True)
    assert names(account) == ["id", "email", "full_name", "org_ref"] and names(base) == ["created_at"]
    id_, email, full, org = account.columns
    assert (id_.primary_key, id_.generated, email.unique, email.default, email.comment, full.nullable, org.nullable) == (True, True, True, "x", "login", True, False)
    assert [(i.columns, i.name) for i in account.indexes] == [(["email"], "by_email")]
    one, many = p.relations
    assert (one.to.model, one.from_columns, one.to_columns, one.on_delete, one.optional) == ("Org", ["org_ref"], ["id"], "CASCADE", False)
    assert (many.to.model, many.through.name, many.cardinality) == ("Role", "account_roles", "many-to-many")
    assert [c["name"] for e in build([p])["entities"] if e["id"] == "auth.accounts" for c in e["columns"]] == ["created_at", "id", "email", "full_name", "org_ref"]


def test_annotations():
    p = php_orms.doctrine("src/Good.php", ANNOTATIONS)
    (good,) = p.entities
    assert (good.name, names(good), [i.columns for i in good.indexes]) == ("goods", ["id", "name", "shelf_id"], [["name"]])
    assert good.columns[0].generated and good.columns[1].type == "string" and good.columns[1].nullable
    assert (p.relations[0].to.model, p.relations[0].from_columns, p.relations[0].optional) == ("Shelf", ["shelf_id"], True)


def test_what_is_no_mapping():
    assert not php_orms.doctrine_detect("a.php", "<?php class A extends Model {}") and php_orms.laravel_detect("a.php", "<?php class A extends Model {}")
    assert not php_orms.laravel_detect("a.php", ATTRIBUTES) and not php_orms.laravel_detect("a.php", "<?php class Helper { function run() {} }")


@pytest.mark.parametrize("text", [MIGRATION, MODEL, ATTRIBUTES, ANNOTATIONS, "<?php #[", "/** @ORM\\Column("])
def test_half_typed_files(text):
    for n in range(0, len(text) + 1, 19):
        php_orms.laravel("a.php", text[:n])
        php_orms.doctrine("a.php", text[:n])
    for read in (php_orms.laravel, php_orms.doctrine):
        shape = lambda t: [(e.name, names(e), e.source.line) for e in read("a.php", t).entities]
        assert shape(text) == shape(text.replace("\n", "\r\n"))
